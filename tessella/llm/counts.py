"""Token counts by a transducer compiled from a merge vocabulary.

After each character of a text the last token of the text so far is unique: the token that ends
there, encodes to itself and keeps its border to the last token before it. So the number of
tokens so far is a function of a finite state: for each start of a token that may still be
going on, its prefix, the last token before it and the count there relative to now. `Machine`
compiles these states and their transitions (next state, tokens emitted) as texts ask for them.

A chunk of text is a map from state to (state, tokens). Chunks of a long text are run apart: from
the start state, then from the states that the chunk before may end in, which differs only until both
runs are in the same state. Maps are composed in a tree, neighbours first, without the texts.
"""

from __future__ import annotations

import functools
import gc
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.arrow import map_texts, numbered
from tessella.session import durable

#: Fixed value: the mark that stands for a space in the pieces.
SPACE = "▁"
CHUNK = 32_768
#: Maps of chunks that are composed in one group.
FAN = 64
#: Bounds of a task's memory: compiled states, remembered units, remembered borders. Beyond them all is compiled anew.
STATES, UNITS, BORDERS = 260_000, 260_000, 400_000
NEVER, SINGLE = 1 << 60, (-1, "", "")


class Machine(dict):
    """As a dict: unit (from one border to the next) -> its tokens."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        super().__init__()
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only merge models that leave the text as it is")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.bytes = model.trainer_spec.byte_fallback
        self.score = {p.piece: p.score for p in model.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL}
        if any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces are not handled")
        # a space never follows a visible character inside a piece: texts may be cut there
        self.cut_at_space = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.known = set("".join(self.score))
        self.child: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        for p in [*self.score, *self.known]:
            node = 0
            for c in p:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.token.append(None)
                node = self.child[node][c]
            self.token[node] = p
        better = {x: i for i, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: better[x] for p, x in self.score.items() if len(p) > 1}
        self._whole: dict[str, bool] = {}
        self.made: dict[str, tuple[int, str, str]] = {}
        # where parts come before the whole, the order of merges is that of their ranks
        for p in self.rank:
            self.whole(p)
        self.unordered = {x for x, (n, a, b) in self.made.items() if any(len(y) > 1 and self.made[y][0] >= n for y in (a, b))}
        self._forget()

    def _forget(self) -> None:
        self.borders: dict[tuple[str, str], bool] = {}
        self.names: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.next: list[dict[str, tuple[int, int]]] = []
        self.start = self.state(((0, "", 0),))

    def state(self, name: tuple) -> int:
        if name not in self.number:
            self.number[name] = len(self.names)
            self.names.append(name)
            self.next.append({})
        return self.number[name]

    # -- the vocabulary's own rule, on two tokens at most --------------------------------------

    def merge(self, text: str) -> list[str]:
        """Best score first, leftmost among equals; what each token was last made of is noted."""
        parts = list(text)
        while len(parts) > 1:
            joined = [self.rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            best = min(joined)
            if best == NEVER:
                break
            i = joined.index(best)
            token = parts[i] + parts[i + 1]
            self.made.setdefault(token, (best, parts[i], parts[i + 1]))
            parts[i : i + 2] = [token]
        return parts

    def whole(self, token: str) -> bool:
        """Does the token's own text encode to it?"""
        if token not in self._whole:
            self._whole[token] = len(self.merge(token)) == 1
        return self._whole[token]

    def border(self, a: str, b: str) -> bool:
        """Do `a` and `b` stay apart when they follow each other?

        Their last merges are undone, the later one first. Two parts that met at some time would
        have joined had their rank come before the merge that ended the meeting.
        """
        if not a:
            return True
        k = (a, b)
        if k not in self.borders:
            self.borders[k] = self._border(a, b)
        return self.borders[k]

    def _border(self, a: str, b: str) -> bool:
        if a in self.unordered or b in self.unordered:
            return self.merge(a + b) == [a, b]
        before = NEVER
        while True:
            if self.rank.get(a + b, NEVER) < before:
                return False
            ma, mb = self.made.get(a, SINGLE), self.made.get(b, SINGLE)
            if ma is SINGLE and mb is SINGLE:
                return True
            if ma[0] > mb[0]:
                before, a = ma[0], ma[2]
            else:
                before, b = mb[0] + 1, mb[1]  # among equals the left one comes first

    def cost(self, token: str) -> int:
        return 1 if token in self.score or not self.bytes else len(token.encode())

    # -- compilation -------------------------------------------------------------------------

    def compile(self, state: int, c: str) -> tuple[int, int]:
        if c not in self.known:  # no piece holds it: what follows does not depend on what came before
            out = (self.start, len(c.encode()) if self.bytes else 1)
        else:
            going, found = [], None
            for node, last, before in self.names[state]:
                to = self.child[node].get(c)
                if to is None:
                    continue
                going.append((to, last, before))
                token = self.token[to]
                if found is None and token is not None and self.whole(token) and self.border(last, token):
                    found = (token, before + self.cost(token))
            token, emitted = found
            name = tuple((node, last, before - emitted) for node, last, before in going if self.child[node])
            out = (self.state((*name, (0, token, 0))), emitted)
        self.next[state][c] = out
        return out

    def run(self, text: str, state: int) -> tuple[int, int]:
        """(state, tokens) after `text`."""
        total, table = 0, self.next
        for c in text:
            step = table[state].get(c)
            if step is None:
                step = self.compile(state, c)
            state, n = step
            total += n
        return state, total

    def tidy(self, state: int | None = None) -> int:
        """`state`, or the start, under its number after the tables were emptied if they had grown over their bounds."""
        state = self.start if state is None else state
        if len(self.names) <= STATES and len(self.borders) <= BORDERS:
            return state
        saved = self.save(state)
        self._forget()
        return self.load(saved)

    def __missing__(self, unit: str) -> int:
        self.tidy()
        n = self.run(unit, self.start)[1]
        if len(self) < UNITS and len(unit) < 40:
            self[unit] = n
        return n

    # -- texts -------------------------------------------------------------------------------

    def normal(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        self.tidy()  # a text adds as many states as it has characters, at most
        if not self.cut_at_space or "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return self.run(self.normal(text), self.start)[1]
        first, *rest = text.split(" ")
        return self.run(self.prefix + first, self.start)[1] + sum(map(self.__getitem__, map(SPACE.__add__, rest)))

    # -- maps of chunks -----------------------------------------------------------------------

    def save(self, state: int) -> str:
        paths = self._paths()
        return json.dumps([(paths[node], last, n) for node, last, n in self.names[state]])

    def load(self, saved: str) -> int:
        name = []
        for prefix, last, n in json.loads(saved):
            node = 0
            for c in prefix:
                node = self.child[node][c]
            name.append((node, last, n))
        return self.state(tuple(name))

    @functools.lru_cache(maxsize=1)
    def _paths(self) -> list[str]:
        out = [""] * len(self.child)
        for node, children in enumerate(self.child):
            for c, to in children.items():
                out[to] = out[node] + c
        return out

    def apply(self, state: int, text: str, end: int, total: int) -> tuple[int, int]:
        """The map of a chunk at `state`; from the start state it gives (`end`, `total`)."""
        other, a, b = self.start, 0, 0
        for c in text:
            if state == other:
                return end, total + a - b
            state, n = self.next[state].get(c) or self.compile(state, c)
            a += n
            other, n = self.next[other].get(c) or self.compile(other, c)
            b += n
        return state, a

    def __hash__(self):
        return id(self)


@functools.lru_cache(maxsize=4)
def machine(path: str) -> Machine:
    return Machine(path)


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(key, n_bytes, n_tokens) of every row, as the vocabulary's library counts them.

    A null text counts as empty: no bytes, no tokens. Texts over `chunk` characters are cut into
    chunks that any task may run, at any character. Repeated and null keys stay rows of their own.
    Extra columns are left out.
    """
    src = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    sized = src.withColumn("n_bytes", F.octet_length("text").cast("long"))
    is_long = F.char_length("text") > chunk

    def whole(texts):
        m = machine(path)
        gc.disable()  # the tables hold no cycles; looking for some takes a third of the time
        try:
            return [[m.count(x) for x in texts]]
        finally:
            gc.enable()

    short = map_texts(sized.where(~is_long), "text", "n_tokens long", whole)
    pieces = F.ceil(F.char_length("text") / F.lit(chunk)).cast("int")
    long_rows = numbered(sized.where(is_long))
    cut = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.substring("text", i * chunk + 1, F.lit(chunk)))
    chunks = long_rows.select(F.col("key.row").alias("row"), F.posexplode(cut).alias("seg", "text"))
    totals = compose_maps(chunk_maps(chunks, path), fan)
    long = long_rows.select("key", "n_bytes", F.col("key.row").alias("row")).join(totals, "row").select("key.key", "n_bytes", "n_tokens")
    return short.select("key", "n_bytes", "n_tokens").unionByName(long).withColumnRenamed("key", key)


def chunk_maps(chunks: DataFrame, path: str) -> DataFrame:
    """(row, seg, came, end, n) of chunks (row, seg, text): the map of each chunk, at every state that may come in.

    First all chunks run from the start state. Then a chunk runs from each state that the one before
    it may end in, until it is where the first run is. An end that was not met before makes a new
    state for the next chunk: rounds go on until there is none, which is after one for texts whose
    runs meet. A state is written as its items, which are the same in every task.
    """
    schema = T._parse_datatype_string("row long, seg int, came string, end string, n long")
    arrow = to_arrow_schema(schema)

    def rows_of(fn):
        def run(batches):
            m = machine(path)
            for batch in batches:
                made = []
                for i in range(batch.num_rows):
                    m.tidy()
                    row, seg, text, *more = (column[i].as_py() for column in batch.columns)
                    made.append((row, seg, *fn(m, (m.prefix if not seg else "") + text.replace(" ", SPACE), *more)))
                yield pa.RecordBatch.from_arrays([pa.array(x, arrow.field(j).type) for j, x in enumerate(zip(*made))] if made else [pa.array([], f.type) for f in arrow], schema=arrow)

        return run

    def first(m, text):
        end, n = m.run(text, m.start)
        return m.save(m.start), m.save(end), n

    def again(m, text, came, end, n):
        out, total = m.apply(m.load(came), text, m.load(end), n)
        return came, m.save(out), total

    base = durable(chunks.repartition("row", "seg").mapInArrow(rows_of(first), schema))
    known, latest = base, base
    while True:
        coming = latest.select("row", (F.col("seg") + 1).alias("seg"), F.col("end").alias("came")).distinct()
        wanted = coming.join(known, ["row", "seg", "came"], "left_anti").join(base.select("row", "seg", "end", "n"), ["row", "seg"])
        wanted = durable(wanted)
        if wanted.isEmpty():
            return known
        latest = durable(chunks.join(wanted, ["row", "seg"]).select("row", "seg", "text", "came", "end", "n").mapInArrow(rows_of(again), schema))
        known = known.unionAll(latest)


def compose_maps(maps: DataFrame, fan: int = FAN) -> DataFrame:
    """(row, n_tokens): maps of `fan` neighbouring chunks are composed to one, then those of as many runs, until one is left.

    Composing looks states up and reads no text; a group holds `fan` maps, however long a text is.
    """
    schema, last = maps.schema, maps.agg(F.max("seg")).first()[0] or 0
    arrow = to_arrow_schema(schema)

    def composed(key: tuple, table: pa.Table) -> pa.Table:
        steps: dict[int, dict] = {}
        for r in table.to_pylist():
            steps.setdefault(r["seg"], {})[r["came"]] = (r["end"], r["n"])
        head, *rest = (steps[s] for s in sorted(steps))
        out = []
        for came, (state, n) in head.items():
            for step in rest:
                state, more = step[state]
                n += more
            out.append((key[0].as_py(), key[1].as_py(), came, state, n))
        return pa.Table.from_arrays([pa.array(x, arrow.field(i).type) for i, x in enumerate(zip(*out))], schema=arrow)

    while last > 0:
        runs = maps.select("row", F.floor(F.col("seg") / fan).cast("int").alias("run"), "seg", "came", "end", "n")
        maps, last = runs.groupBy("row", "run").applyInArrow(composed, schema), last // fan
    # nothing comes into a first chunk but the start state, so one map a row is left
    return maps.select("row", F.col("n").alias("n_tokens"))
