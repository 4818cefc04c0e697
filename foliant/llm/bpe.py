"""BPE encoding and decoding by speculation and verification.

A greedy longest match (Aho-Corasick over the vocabulary) proposes tokens for
each distinct pre-token. A proposal is the exact encoding if and only if every
token is itself reachable by merging and every adjacent pair is compatible,
that is, no merge crosses the boundary before both sides are complete. The
pair check runs on numpy arrays over all proposals at once; only words that
fail it go through the exact merge loop. Merged words are memoised per worker
in a table of bounded size.

Null texts count as empty; an empty text has no tokens. Long texts are cut at
points that the pre-tokeniser always cuts, so memory follows the segment size or
the longest run without such a point; a long word merges through a heap, so time
follows its length and hardly more. Equal merges go from left to right. Rows are
independent of each other: repeated rows give repeated results, an empty table
none. Other columns don't matter to encoding; decoding keeps them.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather, small_batches, tidy

#: The pattern by which byte-level BPE splits text before merging (fixed value).
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters handled at once, distinct chunks of text (and characters of these) remembered by a task.
SEGMENT_CHARS, TABLE_WORDS, TABLE_CHARS = 1_000_000, 250_000, 5_000_000
#: Characters from which a word is merged by itself.
LONG_WORD = 200


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Memo:
    """Token ids of the strings seen so far, in flat arrays; starts anew beyond TABLE_WORDS strings or TABLE_CHARS characters."""

    def __init__(self, encode):
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.ids, self.at, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings in a row, and how many each has."""
        if len(self.place) > TABLE_WORDS or self.chars > TABLE_CHARS:
            self.forget()
        if new := list(set(strings).difference(self.place)):
            self.chars += sum(map(len, new))
            ids, lengths = self.encode(new)
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(lengths) - lengths])
            self.length = np.concatenate([self.length, lengths])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        at = np.fromiter(map(self.place.__getitem__, strings), np.int64, len(strings))
        return gather(self.ids, self.at[at], self.length[at]), self.length[at]


class Codec:
    """A byte-level BPE vocabulary file with its derived tables."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.alphabet = byte_alphabet()
        self.to_alphabet = dict(enumerate(self.alphabet))
        to_byte = {c: bytes([b]) for b, c in enumerate(self.alphabet)}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pre_tokens = regex.compile(PRE_TOKENS)
        self.space_run = re.compile(r"\s ")

        n = 1 + max([*vocab.values(), *special.values()])
        spelled = [b""] * n
        for token, i in vocab.items():
            spelled[i] = token.encode() if token in special else b"".join(to_byte[c] for c in token)
        for token, i in special.items():
            spelled[i] = token.encode()
        self.n, self.spelled = n, spelled
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.rank_of = np.full(n, -1)  # of a merged token: when its merge applies
        self.pairs = {}
        for rank, pair in enumerate(merges):
            a, b = (pair.split(" ") if isinstance(pair, str) else pair)
            a, b, both = vocab[a], vocab[b], vocab[a + b]
            self.pairs[a, b] = (rank, both)
            self.left[both], self.right[both], self.rank_of[both] = a, b, rank
        self.merged_by_rank = np.array([both for _, both in self.pairs.values()])
        self.id_of_char = np.zeros(512, np.int64)
        for c in self.alphabet:
            self.id_of_char[ord(c)] = vocab[c]
        keys = np.array([a * n + b for a, b in self.pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.pairs.values()])[order]

        reachable = self.rank_of < 0
        merged = np.flatnonzero(self.rank_of >= 0)
        whole = np.zeros(n, bool)
        whole[merged] = self.compatible(self.left[merged], self.right[merged], self.rank_of[merged])
        for i in merged[np.argsort(self.rank_of[merged])]:
            reachable[i] = whole[i] and reachable[self.left[i]] and reachable[self.right[i]]
        self.matcher = ahocorasick.Automaton()
        for token, i in vocab.items():
            if token not in special and reachable[i]:
                self.matcher.add_word(token, i)
        self.matcher.make_automaton()

        self.byte_flat, self.byte_at, self.byte_len = flatten(spelled)
        self.of_piece, self.of_chunk = Memo(self.encode_pieces), Memo(self.encode_chunks)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether the boundary between tokens a and b outlives every merge (of rank under ``before``).

        Walks back in time: the piece that was merged last is undone first, and
        in each state the two pieces at the boundary must not have had a merge
        that came earlier than the one just undone. Of equal merges the left one comes first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), len(self.pairs) + 1) if before is None else before.copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit[live])
            good[live[crossed]] = False
            rx, ry = self.rank_of[x], self.rank_of[y]
            on = ~crossed & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[on], x[on], y[on], rx[on], ry[on]
            undo_x = rx > ry
            a[live] = np.where(undo_x, self.right[x], x)
            b[live] = np.where(undo_x, y, self.left[y])
            limit[live] = np.where(undo_x, rx, ry + 1)
        return good

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When each pair merges; beyond the last merge if it doesn't."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], len(self.pairs))

    def merge(self, spelled: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of the words whose proposal failed: short ones side by side, long ones one by one."""
        short = [i for i, s in enumerate(spelled) if len(s) < LONG_WORD]
        parts: list[np.ndarray] = [np.zeros(0, np.int64)] * len(spelled)
        if short:
            ids, n = self.merge_abreast([spelled[i] for i in short])
            for i, part in zip(short, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                parts[i] = part
        for i, s in enumerate(spelled):
            if len(s) >= LONG_WORD:
                parts[i] = self.merge_long(s)
        return np.concatenate([np.zeros(0, np.int64), *parts]), np.array([len(p) for p in parts], np.int64)

    def merge_long(self, spelled: str) -> np.ndarray:
        """One word's merges in order of rank, then place, from a heap; pairs that are gone meanwhile are passed over."""
        ids = self.id_of_char[np.frombuffer(spelled.encode("utf-16-le"), np.uint16)]
        rank = self.ranks(ids[:-1], ids[1:])
        at = np.flatnonzero(rank < len(self.pairs))
        waiting = list(zip(rank[at].tolist(), at.tolist(), strict=True))
        heapq.heapify(waiting)
        piece, after, before, pairs = ids.tolist(), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), self.pairs
        end = len(piece)
        while waiting:
            r, i = heapq.heappop(waiting)
            j = after[i] if piece[i] >= 0 else end
            if j == end or pairs.get((piece[i], piece[j]), (-1,))[0] != r:
                continue
            piece[i], piece[j] = pairs[piece[i], piece[j]][1], -1
            k = after[i] = after[j]
            if k < end:
                before[k] = i
                if found := pairs.get((piece[i], piece[k])):
                    heapq.heappush(waiting, (found[0], i))
            h = before[i]
            if h >= 0 and (found := pairs.get((piece[h], piece[i]))):
                heapq.heappush(waiting, (found[0], h))
        return np.array([p for p in piece if p >= 0], np.int64)

    def merge_abreast(self, spelled: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words at once: each round makes every word's earliest merge, leftmost first."""
        never = len(self.pairs)
        lengths = np.array([len(s) for s in spelled])
        raw = np.frombuffer("".join(spelled).encode("utf-16-le"), np.uint16)
        ids = self.id_of_char[raw]
        word = np.repeat(np.arange(len(spelled)), lengths)
        last = np.append(word[1:] != word[:-1], True)
        rank = np.where(last, never, self.ranks(ids, np.append(ids[1:], 0)))
        out_word, out_ids = [], []
        while len(ids):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            first = np.minimum.reduceat(rank * len(ids) + np.arange(len(ids)), starts)
            best, at = np.divmod(first, len(ids))
            finished = best == never
            if finished.any():
                done = np.repeat(finished, np.diff(np.append(starts, len(ids))))
                out_word.append(word[done])
                out_ids.append(ids[done])
            else:
                done = np.zeros(len(ids), bool)
            at = at[~finished]
            ids[at] = self.merged_by_rank[best[~finished]]
            gone = done
            gone[at + 1] = True
            before = at - 1
            moved = np.cumsum(~gone) - 1
            ids, word, rank = ids[~gone], word[~gone], rank[~gone]
            if not len(ids):
                break
            here = moved[at]
            fresh = np.concatenate([here, moved[before[(before >= 0)]]])
            fresh = fresh[fresh >= 0]
            after = np.minimum(fresh + 1, len(ids) - 1)
            inside = (fresh + 1 < len(ids)) & (word[after] == word[fresh])
            rank[fresh] = np.where(inside, self.ranks(ids[fresh], ids[after]), never)
        word, ids = np.concatenate(out_word), np.concatenate(out_ids)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(spelled))

    def encode_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Speculate on pre-tokens, verify all pairs, merge the failures."""
        spelled = [w.encode().decode("latin-1").translate(self.to_alphabet) if w not in self.special else "" for w in new]
        ends = np.cumsum([len(s) + 1 for s in spelled])
        found = np.array(list(self.matcher.iter_long("\n".join(spelled))), np.int64).reshape(-1, 2)
        at, ids = found[:, 0], found[:, 1]
        word = np.searchsorted(ends, at, side="right")
        same = word[1:] == word[:-1]
        bad = np.flatnonzero(same)[~self.compatible(ids[:-1][same], ids[1:][same])]
        failed = np.unique(word[bad])
        if len(failed):
            keep = ~np.isin(word, failed)
            merged, lengths = self.merge([spelled[w] for w in failed])
            word = np.concatenate([word[keep], np.repeat(failed, lengths)])
            ids = np.concatenate([ids[keep], merged])
        special = [i for i, w in enumerate(new) if w in self.special]
        word = np.concatenate([word, np.array(special, np.int64)])
        ids = np.concatenate([ids, np.array([self.special[new[i]] for i in special], np.int64)])
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(new))

    def encode_chunks(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces: list[str] = []
        counts = []
        for t in new:
            got = self.pieces(t)
            counts.append(len(got))
            pieces += got
        ids, lengths = self.of_piece(pieces)
        # Most chunks are a piece with or without a mark, so both tables would hold nearly the same words.
        self.of_piece.forget()
        bounds = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return ids, np.diff(bounds)

    def pieces(self, text: str) -> list[str]:
        if self.split_special is None or not any(s in text for s in self.special):
            return self.pre_tokens.findall(text)
        out: list[str] = []
        for part in self.split_special.split(text):
            out += [part] if part in self.special else self.pre_tokens.findall(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids, and how many each text has.

        A space after a non-space always starts a pre-token, so a text without
        runs of white space before a space is looked up by its space-separated chunks.
        """
        chunks: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if self.space_run.search(t):
                got = self.pieces(t)
            else:
                got = t.replace(" ", "\ue000 ").split("\ue000") if "\ue000" not in t else self.pieces(t)
            counts[i] = len(got)
            chunks += got
        ids, lengths = self.of_chunk(chunks)
        bounds = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bounds)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.byte_flat, self.byte_at[ids], self.byte_len[ids]).tobytes()


def flatten(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


def segments(text: str) -> Iterator[str]:
    """Cut a long text before a space that follows a non-space; pre-tokens never span that."""
    at = 0
    while len(text) - at > SEGMENT_CHARS:
        cut = at + SEGMENT_CHARS
        while cut < len(text) and not (text[cut] == " " and not text[cut - 1].isspace() and text[cut - 1] not in "\x1c\x1d\x1e\x1f"):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _chunks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Segments of many texts, dealt into runs of about SEGMENT_CHARS."""
    rows, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for s in segments(t or ""):
            rows.append(i)
            parts.append(s)
            size += len(s)
            if size >= SEGMENT_CHARS:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def spell(bpe: Codec, ids: np.ndarray) -> str:
    """The text that token ids spell, a stretch at a time."""
    return b"".join(bpe.decode(ids[i : i + SEGMENT_CHARS]) for i in range(0, len(ids), SEGMENT_CHARS)).decode("utf-8", errors="replace")


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``(id_col, out array<int>)``: the token ids of every whole text; with ``decoded``, a column of that name has what
    they spell, so that a task needs one worker for both ways."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))

    @tidy()
    def run(batches):
        bpe = codec(vocabulary)
        for b in batches:
            counts, ids = np.zeros(b.num_rows, np.int64), []
            for at, parts in _chunks(b.column(1).to_pylist()):
                got, n = bpe.encode(parts)
                np.add.at(counts, at, n)
                ids.append(got)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            columns = [b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))]
            if decoded:
                columns.append(pa.array([spell(bpe, flat[a:z]) for a, z in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, out, *([decoded] if decoded else [])])
        bpe.of_chunk.forget()

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, `{out}` array<int>" + (f", `{decoded}` string" if decoded else ""))


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Appends ``out``, a name that ``encoded`` must not have: the text that the token ids spell."""
    if out.lower() in {c.lower() for c in encoded.columns}:
        raise ValueError(f"the rows have a column {out} already")
    small_batches(encoded.sparkSession)

    @tidy()
    def run(batches):
        bpe = codec(vocabulary)
        for b in batches:
            column = b.column(b.schema.get_field_index(ids_col))
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
            texts = [spell(bpe, flat[a:z]) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, `{out}` string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode every document and digest both results."""
    both = encode(docs, vocabulary, decoded="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
