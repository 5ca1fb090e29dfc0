"""Encoding and decoding by a SentencePiece BPE model, in chunks of giant documents.

A BPE encoding is the only path of pieces through a text on which every piece and every pair of
neighbours encodes to itself. Taken as weights 0 (allowed) and -inf (not), encoding is a max-plus
problem over boundary states, a state being the piece that crosses or ends at a chunk's boundary.
Each chunk of a giant document gives a transfer matrix from its entry to its exit states; matrices
combine pairwise by the max-plus product, which is associative, in a tree; the states on the one finite
path are then handed down the tree and every chunk is backtraced on its own. Documents of one chunk need no matrix.

No piece of such a model runs from a non-blank into a blank, so a word that begins in a chunk resets
the state, and the words between the first and the last such place go to the library as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlake.session import materialise

from .tokens import checksum, id_lists, tokenizer_path

BLANK = "▁"
CHUNK = 32_768
#: Matrices of one document that a task multiplies at once.
FAN = 16
#: Looked up by name on each executor; a path that all of them have will do too.
MODEL = "piece_bpe_32k.model"
WORD = re.compile(f"{BLANK}+[^{BLANK}]*")


class PieceCodec:
    """One model in one Python worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.model, self.model.vocab_size()
        special = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)}
        self.id_of = {m.id_to_piece(i): i for i in range(n) if i not in special}
        self.score = {p: m.get_score(i) for p, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        if any(WORD.search(p, 1) for p in self.id_of if p[0] != BLANK or p.strip(BLANK)):
            raise ValueError("a piece holds a blank after a non-blank; words do not reset the state")
        self.byte_id = {b: m.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.text_of = [b"" if m.is_control(i) else m.id_to_piece(i).replace(BLANK, " ").encode() for i in range(n)]
        self.text_of[m.unk_id()] = " ⁇ ".encode()
        for b, i in self.byte_id.items():
            self.text_of[i] = bytes([b])
        self.merged = lru_cache(200_000)(self._merge)
        self.fits = lru_cache(400_000)(lambda a, b: self.merged(a + b) == (a, b))

    def _merge(self, text: str) -> tuple[str, ...]:
        """BPE by definition: the best-scored pair that is a piece, leftmost first. For short texts."""
        parts = list(text)
        while True:
            best = max(((self.score[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.score), default=None)
            if best is None:
                return tuple(parts)
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def walk(self, z: str, start: int, entry: str | None, end: int) -> dict[int, str]:
        """For each position up to end, the last piece of the path from entry to there, where there is one."""
        last: dict[int, str | None] = {start: entry}
        for i in range(start + 1, end + 1):
            for s in range(i - 1, max(start, i - self.longest) - 1, -1):
                if s in last:
                    piece = z[s:i]
                    if i - s > 1 and piece not in self.score:
                        continue
                    before = last[s]
                    if self.merged(piece) == (piece,) if before is None else self.fits(before, piece):
                        last[i] = piece
                        break
        return last

    def path_ids(self, z: str, last: dict[int, str], end: int) -> bytes:
        out: list[bytes] = []
        while last[end] is not None and (end - len(last[end])) in last:
            piece = last[end]
            out.append(self._ids(piece))
            end -= len(piece)
            if last[end] is None:
                break
        return b"".join(reversed(out))

    def _ids(self, piece: str) -> bytes:
        own = self.id_of.get(piece)
        return np.array([own] if own is not None else [self.byte_id[b] for b in piece.encode()], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as bytes; an empty text has none."""
        return self.encode_words(BLANK + text) if text else b""

    def encode_words(self, z: str) -> bytes:
        """Ids of whole words, the first of which starts with a blank. The library adds that blank itself."""
        if z.strip(f" {BLANK}"):
            return np.array(self.model.encode(z[1:]), "<u4").tobytes()
        z = z.replace(" ", BLANK)
        return self.path_ids(z, self.walk(z, 0, None, len(z)), len(z))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.text_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    # Chunks: z[c0:c1] of a giant text, with a margin of longest - 1 characters on both sides.

    def entries(self, z: str, c0: int) -> list[tuple[int, int]]:
        """Pieces (end, length) that start before c0 and end at c0 or later: the boundary states there."""
        if c0 == 0:
            return [(0, 0)]
        return [
            (q, m)
            for q in range(c0, min(len(z), c0 + self.longest - 1) + 1)
            for m in range(q - c0 + 1, min(self.longest, q) + 1)
            if m == 1 or z[q - m : q] in self.score
        ]

    def resets(self, z: str, c0: int, c1: int) -> tuple[int, int] | None:
        """First and last place in z[c0:c1] where a word begins."""
        starts = [x.start() for x in re.finditer(f"(?<!{BLANK}){BLANK}", z[c0 - 1 if c0 else 0 : c1])]
        starts = [s + (c0 - 1 if c0 else 0) for s in starts if not (c0 and s == 0)]
        return (starts[0], starts[-1]) if starts else None

    def _exits(self, z: str, last: dict[int, str], c1: int) -> list[tuple[int, int]]:
        """States at c1 that a walk reaches: its pieces that start before c1."""
        ends = range(c1, min(len(z), c1 + self.longest - 1) + 1)
        return [(q, len(last[q])) for q in ends if last.get(q) and q - len(last[q]) < c1]

    def transfer(self, z: str, c0: int, c1: int) -> tuple[list, list, np.ndarray]:
        """Entry states, exit states, and the max-plus matrix between them."""
        ins, at = self.entries(z, c0), self.resets(z, c0, c1)
        reach = min(len(z), c1 + self.longest - 1)
        walk = lambda q, m, end: self.walk(z, q, z[q - m : q] if m else None, end)
        if at:
            first, final = at
            outs = self._exits(z, self.walk(z, final, None, reach), c1)
            ok = [q == first or (q < first and first in walk(q, m, first)) for q, m in ins]
            return ins, outs, np.where(np.array(ok)[:, None] & np.ones(len(outs), bool), 0.0, -np.inf)
        each = [self._exits(z, walk(q, m, reach), c1) for q, m in ins]
        outs = sorted({x for e in each for x in e})
        return ins, outs, np.array([[0.0 if x in e else -np.inf for x in outs] for e in map(set, each)]).reshape(len(ins), len(outs))

    def backtrace(self, z: str, c0: int, c1: int, entry: tuple[int, int], exit_: tuple[int, int]) -> bytes:
        """Ids of the pieces that start in z[c0:c1], given the states at its ends."""
        (q, m), at = entry, self.resets(z, c0, c1)
        before = z[q - m : q] if m else None
        if not at:
            return self.path_ids(z, self.walk(z, q, before, exit_[0]), exit_[0]) if exit_[0] > q else b""
        first, final = at
        head = self.path_ids(z, self.walk(z, q, before, first), first) if q < first else b""
        return head + self.encode_words(z[first:final]) + self.path_ids(z, self.walk(z, final, None, exit_[0]), exit_[0])


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(tokenizer_path(path))


Matrix = tuple[list, list, np.ndarray]


def product(left: Matrix, right: Matrix) -> Matrix:
    """The max-plus product of two neighbours: from the left one's entry to the right one's exit states."""
    ins, mid, w = left
    outs, place = right[1], {s: i for i, s in enumerate(right[0])}
    best = np.full((len(ins), len(outs)), -np.inf)
    for i, s in enumerate(mid):
        if s in place:
            np.maximum(best, w[:, i, None] + right[2][None, place[s], :], out=best)
    return ins, outs, best


def products(chunks: list[Matrix]) -> list[list[Matrix]]:
    """Neighbours multiplied pairwise until one matrix is left: each round's matrices, the chunks first."""
    rounds = [chunks]
    while len(own := rounds[-1]) > 1:
        rounds.append([product(*own[i : i + 2]) if i + 1 < len(own) else own[i] for i in range(0, len(own), 2)])
    return rounds


State = tuple[int, int]


def hand_down(rounds: list[list[Matrix]], entry: State, exit_: State) -> list[tuple[State, State]]:
    """The entry and exit state of each chunk, from those of the whole: each product's halves meet in one state."""
    states = [(entry, exit_)]
    for own in rounds[-2::-1]:
        below = []
        for i, (first, last) in zip(range(0, len(own), 2), states, strict=True):
            if i + 1 == len(own):
                below.append((first, last))
                continue
            (ins, mid, w), (mid_in, outs, v) = own[i], own[i + 1]
            before, after = w[ins.index(first)], v[:, outs.index(last)]
            place = {s: k for k, s in enumerate(mid_in)}
            met = max((s for k, s in enumerate(mid) if s in place), key=lambda s: before[mid.index(s)] + after[place[s]])
            below += [(first, met), (met, last)]
        states = below
    return states


def whole_path(whole: Matrix) -> tuple[State, State]:
    """Where the best path of a whole document begins and ends."""
    ins, outs, weight = whole
    return ins[0], max((s for s, x in zip(outs, weight[0], strict=True) if x > -np.inf), key=lambda s: s[0])


def combine(chunks: list[Matrix]) -> list[tuple[State, State]]:
    """The entry and exit state of each chunk on the best path."""
    rounds = products(chunks)
    return hand_down(rounds, *whole_path(rounds[-1][0]))


STATES = "entries array<int>, exits array<int>, weight array<boolean>"


def _flat(states: list[tuple[int, int]], shift: int) -> list[int]:
    return [x for q, m in states for x in (q + shift, m)]


def _pairs(flat) -> list[tuple[int, int]]:
    flat = [int(x) for x in flat]
    return list(zip(flat[::2], flat[1::2], strict=True))


def _matrix(entries, exits, weight) -> Matrix:
    i, o = _pairs(entries), _pairs(exits)
    return i, o, np.where(np.array(weight, bool), 0.0, -np.inf).reshape(len(i), len(o))


def _matrices(f: pd.DataFrame) -> list[Matrix]:
    return [_matrix(*x) for x in zip(f["entries"], f["exits"], f["weight"], strict=True)]


def boundary_states(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """key, chunk, entry and exit of every chunk of every document, from the chunks' transfer matrices.

    A tree of products: fan neighbours are multiplied in one task, then fan of those products, until a
    document has fan matrices or fewer; then the states go back down the same tree. So no task holds
    more than fan matrices of a document at once, however long it is.
    """
    top = matrices.agg(F.max("chunk")).first()[0] or 0  # the longest document's number of chunks
    levels = [matrices]
    parent = F.floor(F.col("chunk") / fan).cast("int")

    def multiplied(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("chunk")
        ins, outs, weight = products(_matrices(f))[-1][0]
        return pd.DataFrame({
            "key": f["key"].iloc[:1].tolist(), "chunk": [int(f["chunk"].iloc[0]) // fan],
            "entries": [_flat(ins, 0)], "exits": [_flat(outs, 0)], "weight": [(weight.ravel() == 0).tolist()],
        })

    while top >= fan:
        above = levels[-1].withColumn("parent", parent).groupBy("key", "parent").applyInPandas(multiplied, f"key string, chunk int, {STATES}")
        levels.append(materialise(above, "products"))
        top //= fan

    def placed(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("chunk")
        rounds = products(_matrices(f))
        ends = (_pairs(f["entry"].iloc[0])[0], _pairs(f["exit"].iloc[0])[0]) if "entry" in f else whole_path(rounds[-1][0])
        states = hand_down(rounds, *ends)
        return f[["key", "chunk"]].assign(entry=[_flat([a], 0) for a, _ in states], exit=[_flat([b], 0) for _, b in states])

    schema = "key string, chunk int, entry array<int>, exit array<int>"
    states = levels[-1].groupBy("key").applyInPandas(placed, schema)
    for level in levels[-2::-1]:
        above = states.withColumnRenamed("chunk", "parent")
        states = level.withColumn("parent", parent).join(above, ["key", "parent"]).groupBy("key", "parent").applyInPandas(placed, schema)
    return states


def encode(docs: DataFrame, model: str | None = None, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, ids (array<int>), n_chunks for every document.

    Null text counts as empty and has no ids; a null doc_id is kept. Repeated rows are encoded each.
    An empty table gives no rows; other columns are not read.
    """
    model = model or MODEL
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for b in batches:
            ids = id_lists([own.encode(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(np.ones(b.num_rows, np.int32))], ["doc_id", "ids", "n_chunks"])

    small = texts.filter(F.length("text") < chunk).mapInArrow(whole, "doc_id long, ids array<int>, n_chunks int")

    margin = codec(model).longest
    key = ["doc_id", "key"]  # key names the row's id and text, and is never null
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.sha2("text", 256))
    giant = (
        texts.filter(F.length("text") >= chunk)
        .groupBy("doc_id", named.alias("key")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
        .withColumn("text", F.concat(F.lit(BLANK), F.translate("text", " ", BLANK)))
    )
    n_chunks = F.ceil(F.length("text") / chunk).cast("int")
    chunks = (
        giant.select(*key, "times", n_chunks.alias("n_chunks"), "text", F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("chunk"))
        .select(
            *key, "times", "n_chunks", "chunk",
            F.greatest(F.lit(0), F.col("chunk") * chunk - margin).alias("from"),
            F.least(F.length("text"), (F.col("chunk") + 1) * chunk).alias("to"),
            F.substring("text", F.greatest(F.lit(0), F.col("chunk") * chunk - margin) + 1, F.lit(chunk + 2 * margin)).alias("slice"),
        )
        .repartition(F.col("key"), F.col("chunk"))
    )

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model)
        for f in frames:
            found = [own.transfer(z, c * chunk - a, to - a) for c, a, to, z in zip(f["chunk"], f["from"], f["to"], f["slice"], strict=True)]
            yield f[["key", "chunk"]].assign(
                entries=[_flat(i, a) for (i, _, _), a in zip(found, f["from"], strict=True)],
                exits=[_flat(o, a) for (_, o, _), a in zip(found, f["from"], strict=True)],
                weight=[(w.ravel() == 0).tolist() for _, _, w in found],
            )

    found = chunks.select("key", "chunk", "from", "to", "slice").mapInPandas(matrices, f"key string, chunk int, {STATES}")
    states = boundary_states(materialise(found, "matrices"), fan)

    def traced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model)
        for f in frames:
            ids = []
            for c, a, to, z, (q, m), (x, n) in zip(f["chunk"], f["from"], f["to"], f["slice"], f["entry"], f["exit"], strict=True):
                ids.append(np.frombuffer(own.backtrace(z, c * chunk - a, to - a, (q - a, m), (x - a, n)), "<u4").astype("i4"))
            yield f[[*key, "times", "n_chunks", "chunk"]].assign(ids=ids)

    parts = chunks.join(states, ["key", "chunk"]).mapInPandas(traced, "doc_id long, key string, times long, n_chunks int, chunk int, ids array<int>")
    large = (
        parts.groupBy(*key, "times", "n_chunks")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
        .select("doc_id", "ids", "n_chunks", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_copy")).drop("_copy")
    )
    return small.unionByName(large)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids count as none."""
    model = model or MODEL

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for b in batches:
            out = [own.decode(ids) for ids in _id_arrays(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(texts, "doc_id long, text string")


def _id_arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    for k in range(len(column)):
        yield values[offsets[k] : offsets[k + 1]] if column[k].is_valid else values[:0]


def round_trip(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Digest of encoded rows and of the text that decoding gives back: doc_id, n_ids, ids_crc32, n_chunks, n_chars, decoded_sha256."""
    model = model or MODEL

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for b in batches:
            out: list[list] = [[], [], [], []]
            for ids in _id_arrays(b.column(1)):
                text = own.decode(ids)
                for c, v in zip(out, (len(ids), checksum(ids.astype("<u4").tobytes()), len(text), sha256(text.encode()).hexdigest()), strict=True):
                    c.append(v)
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in out[:2]), b.column(2), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_ids", "ids_crc32", "n_chunks", "n_chars", "decoded_sha256"])

    return encoded.select("doc_id", "ids", "n_chunks").mapInArrow(
        digest, "doc_id long, n_ids long, ids_crc32 long, n_chunks int, n_chars long, decoded_sha256 string"
    )
