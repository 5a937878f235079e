"""BPE encoding and decoding by tree concatenation.

Text is cut where the pre-tokenizer cuts it anyway. What it leaves unsplit is merged directly
while it is short; longer pieces are halved, the halves are encoded on their own, and the two
token lists are joined: a window of tokens around the join is encoded anew and doubled until its
first and last token are those that stood there before. A token list is the encoding of its bytes
exactly when every two neighbours encode to themselves, so from there on nothing can change.

Texts over `segment` characters become rows of segments that any task may encode; a segment
border inside an unsplit piece is one more join of the same tree.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.arrow import map_texts, numbered

#: Fixed value: the public pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fixed value: the id that ends a document in the public byte-level vocabulary.
END_OF_TEXT = 50256

#: Bytes up to which a piece is merged directly, and up to which a whole unit is left to the library's merge loop.
LEAF, DIRECT = 64, 256
#: Units remembered by a task at most.
REMEMBERED = 300_000
#: Characters of a segment, and how far back from its end a cut is looked for.
SEGMENT, REACH = 32_768, 4_096


class Dirty(Exception):
    """A unit that its neighbours may change."""


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: visible Latin-1 stands for itself, the rest is moved above 255."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe(dict):
    """Encoder and decoder of a byte-level vocabulary; as a dict, unit -> packed ids of " " + unit."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        order = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            order[bytes(back[c] for c in a + b)] = rank
        self.ids, self.order = vocab, order
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for b, i in vocab.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        by_id = [order[b] for b in sorted(vocab, key=vocab.get) if b in order]
        if by_id != sorted(by_id):
            raise ValueError("ids are expected in the order of the merges")
        self.short = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.split = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    # -- one unsplit piece ------------------------------------------------------------------

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.order.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ids[p] for p in parts]

    def piece(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.piece(piece[:half]), self.piece(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both texts in a row, from the encodings of each."""
        if not left or not right:
            return left + right
        w = 2
        while True:
            a, b = left[-w:], right[:w]
            window = b"".join(self.bytes[i] for i in a + b)
            # an undivided window over the leaf size is again a tree, on its own halves
            now = self.merge(window) if len(window) <= 4 * LEAF or w >= max(len(left), len(right)) else self.piece(window)
            if (w >= len(left) or now[0] == a[0]) and (w >= len(right) or now[-1] == b[-1]):
                return left[: max(0, len(left) - w)] + now + right[w:]
            w *= 2

    # -- texts ------------------------------------------------------------------------------

    def plain(self, text: str) -> bytes:
        """Packed ids of a text without special tokens."""
        if len(text) <= DIRECT:
            return array("I", self.short.encode_ordinary(text)).tobytes()
        return self.pieces(self.split.findall(text))

    def pieces(self, pieces: list[str]) -> bytes:
        out, run = [], []
        for p in pieces:
            if len(p) > DIRECT:
                out += [self._run(run), np.array(self.piece(p.encode()), "<u4").tobytes()]
                run = []
            else:
                run.append(p)
        return b"".join([*out, self._run(run)])

    def _run(self, pieces: list[str]) -> bytes:
        """Pieces in a row split into the same pieces again, but for gaps at the end, which see no next character."""
        n = len(pieces)
        while n and pieces[n - 1].isspace():
            n -= 1
        gaps = [i for p in pieces[n:] for i in self.piece(p.encode())]
        return array("I", self.short.encode_ordinary("".join(pieces[:n])) + gaps).tobytes()

    def whole(self, text: str) -> bytes:
        """Packed ids of any text; strings of special tokens become their ids."""
        if self.specials is None:
            return self.plain(text)
        parts = self.specials.split(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self.plain(p) for i, p in enumerate(parts) if p)

    def __missing__(self, unit: str) -> bytes:
        if not unit or unit[0].isspace() or unit[-1].isspace():
            raise Dirty
        out = self.plain(" " + unit)
        if len(self) < REMEMBERED and len(unit) < 40 and "\n" not in unit:
            self[unit] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids. A single space after a visible character always begins
        a new piece, so texts without other gaps are looked up unit by unit."""
        if not text:
            return b""
        if self.specials is not None and self.specials.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise Dirty
            return self.plain(first) + b"".join(map(self.__getitem__, rest))
        except Dirty:
            return self.plain(text)

    def decode(self, ids: bytes | None) -> str:
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids or b"", "<u4").tolist()]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


# -- segments of long texts -----------------------------------------------------------------------


def _kind(c: str) -> str:
    if c.isspace() and c not in "\x1c\x1d\x1e\x1f":
        return "s"
    k = unicodedata.category(c)[0]
    return k if k in "LN" else "p"


def cut(text: str, at: int, reach: int = REACH) -> tuple[int, bool]:
    """A place at or before `at` to cut, and whether it lies inside an unsplit piece.

    The pattern never takes a visible character and a following space together, nor a letter or
    digit and a following character of another kind: such places are free. Else the stretch
    is at most three runs of one kind, and the middle of the longest is taken.
    """
    low = max(1, at - reach)
    kinds = [_kind(c) for c in text[low - 1 : at + 1]]
    for i in range(len(kinds) - 1, 0, -1):
        a, b = kinds[i - 1], kinds[i]
        if a != b and (b == "s" or a in "LN"):
            return low - 1 + i, False
    best, start = (0, 0), 0
    for i in range(1, len(kinds) + 1):
        if i == len(kinds) or kinds[i] != kinds[start]:
            best, start = max(best, (i - start, start)), i
    return low - 1 + best[1] + best[0] // 2, True


def segments(text: str, size: int = SEGMENT) -> list[tuple[bool, str]]:
    """(glued to the one before, text) of consecutive segments."""
    out, start, glued = [], 0, False
    while len(text) - start > size + size // 2:
        end, inside = cut(text, start + size, min(REACH, size // 2))
        out.append((glued, text[start:end]))
        start, glued = end, inside
    return [*out, (glued, text[start:])]


def ends(bpe: ByteBpe, text: str) -> tuple[list[int], list[int] | None, list[int]]:
    """(first piece, what lies between, last piece) as ids; None between: it is one piece."""
    pieces = bpe.split.findall(text)
    one = lambda p: bpe.piece(p.encode())
    if len(pieces) == 1:
        return one(pieces[0]), None, []
    return one(pieces[0]), np.frombuffer(bpe.pieces(pieces[1:-1]), "<u4").tolist(), one(pieces[-1])


def glue(bpe: ByteBpe, a: tuple, b: tuple, glued: bool) -> tuple:
    """Two neighbouring segments as one."""
    if glued:
        if a[1] is None and b[1] is None:
            return bpe.join(a[0], b[0]), None, []
        if a[1] is None:
            return bpe.join(a[0], b[0]), b[1], b[2]
        if b[1] is None:
            return a[0], a[1], bpe.join(a[2], b[0])
        return a[0], a[1] + bpe.join(a[2], b[0]) + b[1], b[2]
    flat = lambda x: x[0] if x[1] is None else x[0] + x[1] + x[2]
    if a[1] is None:
        return (a[0], [], b[0]) if b[1] is None else (a[0], b[0] + b[1], b[2])
    if b[1] is None:
        return a[0], a[1] + a[2], b[0]
    return a[0], a[1] + a[2] + flat((b[0], b[1], [])), b[2]


def tree(bpe: ByteBpe, parts: list[tuple[bool, tuple]]) -> list[int]:
    """Pairs of neighbours are joined, level by level."""
    while len(parts) > 1:
        parts = [(parts[i][0], glue(bpe, parts[i][1], parts[i + 1][1], parts[i + 1][0]) if i + 1 < len(parts) else parts[i][1]) for i in range(0, len(parts), 2)]
    x = parts[0][1]
    return x[0] if x[1] is None else x[0] + x[1] + x[2]


# -- operators --------------------------------------------------------------------------------------


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(key, n_tokens, ids) of every row; ids are packed little-endian unsigned 32-bit numbers.

    A null or empty text has no ids. Strings of special tokens inside a text become their ids, as
    the public library does by default. Repeated and null keys stay rows of their own. Other
    columns are left out.
    """
    fn = lambda texts: _encoded([byte_bpe(path).encode(x) for x in texts])
    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    is_long = F.coalesce(F.char_length("text") > segment, F.lit(False))
    short = map_texts(src.where(~is_long), "text", "n_tokens long, ids binary", fn)
    long_rows = numbered(src.where(is_long))
    kind = long_rows.schema["key"].dataType
    cut_schema = T.StructType([T.StructField("key", kind), *T._parse_datatype_string("seg int, glued boolean, special boolean, text string").fields])
    cut_arrow = to_arrow_schema(cut_schema)

    def cut_up(batches):
        bpe = byte_bpe(path)
        for batch in batches:
            for k, x in zip(batch.column(0), batch.column(1)):
                rows = []
                for i, part in enumerate(bpe.specials.split(x.as_py()) if bpe.specials else [x.as_py()]):
                    if i % 2:
                        rows.append((False, True, part))
                    elif part:
                        rows += [(g, False, t) for g, t in segments(part, segment)]
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), cut_arrow.field(0).type), pa.array(range(len(rows)), pa.int32()), *(pa.array([r[j] for r in rows], cut_arrow.field(2 + j).type) for j in range(3))], schema=cut_arrow)

    ids_schema = T.StructType([T.StructField("key", kind), *T._parse_datatype_string("seg int, glued boolean, head binary, mid binary, tail binary").fields])
    ids_arrow = to_arrow_schema(ids_schema)

    def each(batches):
        bpe = byte_bpe(path)
        pack = lambda x: None if x is None else np.array(x, "<u4").tobytes()
        for batch in batches:
            made = [([bpe.special[t]], None, []) if s else ends(bpe, t) for s, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(ids_arrow.field(i).type) for i in range(3)), *(pa.array([pack(m[j]) for m in made], pa.binary()) for j in range(3))], schema=ids_arrow)

    joined_schema = T.StructType([T.StructField("key", kind), *T._parse_datatype_string("n_tokens long, ids binary").fields])
    joined_arrow = to_arrow_schema(joined_schema)

    def together(table: pa.Table) -> pa.Table:
        bpe = byte_bpe(path)
        back = lambda x: None if x is None else np.frombuffer(x, "<u4").tolist()
        rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
        ids = tree(bpe, [(r["glued"], (back(r["head"]), back(r["mid"]), back(r["tail"]))) for r in rows])
        return pa.Table.from_arrays([pa.array([rows[0]["key"]], joined_arrow.field(0).type), pa.array([len(ids)], pa.int64()), pa.array([np.array(ids, "<u4").tobytes()], pa.binary())], schema=joined_arrow)

    spread = long_rows.mapInArrow(cut_up, cut_schema).repartition(F.col("key"), F.col("seg"))
    long = spread.mapInArrow(each, ids_schema).groupBy("key").applyInArrow(together, joined_schema)
    return short.select("key", "n_tokens", "ids").unionByName(long.withColumn("key", F.col("key.key"))).withColumnRenamed("key", key)


def _encoded(ids: list[bytes]) -> list[list]:
    return [[len(x) // 4 for x in ids], ids]


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """`df` with `text` decoded from the packed ids; ids of special tokens give their strings, null gives an empty text.
    Bytes that are no UTF-8 become replacement characters."""
    names = [c for c in df.columns if c != text]
    schema = T.StructType([*[T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(names)], T.StructField(text, T.StringType())])
    arrow, at = to_arrow_schema(schema), names.index(ids)

    def run(batches):
        bpe = byte_bpe(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(arrow.field(i).type) for i in range(len(names))), pa.array([bpe.decode(x.as_py()) for x in batch.column(at)], pa.string())], schema=arrow)

    out = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)]).mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], text)
