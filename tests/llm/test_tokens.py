"""Tokens, counts and packing against the public libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessella.llm import binary, bpe, counts, packing
from tessella.llm.words import WordTokens

BYTE, PIECE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = ["", " ", "a", "  a  b ", "a\nb\r\n", "it's DON'T ''s !!!'s", "<|endoftext|>x<|startoftext|> y", "日本語 ñandú \xa0x \x85 \x1c z\x1d\x1d q", "É ß ẞ İ ΑΣ Σ µ Ÿ", "é ́x", "🙂🙂 🙂", "a▁b", "a\x00b", ");\r\n x", "x" * 900, "aB3" * 400, "-" * 700, "\n" * 300 + "x", " " * 200 + "x", "<s>hi</s> <unk> <0x41>"]
SCHEMA = "doc_id long, text string, n_tokens string, k0 int, key int"


def noise(n, seed=1, most=400):
    rng = random.Random(seed)
    for _ in range(n):
        alphabet = rng.choice(["ab", "the aning", "aeiou'st", "12 3", "日本é", " \n\tab", "xyz!'s ", "Ab C. D,", " -=*"])
        yield "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, most)))


@pytest.fixture(scope="module")
def texts():
    return [*ODD, *noise(60), "word " * 9000, "z" * 40_000 + " a " + "é!" * 3000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, x, "clash", 1, 2) for i, x in enumerate(texts)] + [(len(texts), None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(name)
    t.no_padding()
    t.no_truncation()
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_pieces_and_segments_join_to_the_same_ids():
    own, want = bpe.byte_bpe(BYTE), library(BYTE)
    for x in [*ODD, *noise(120, 2, 1200)]:
        assert np.frombuffer(own.encode(x), "<u4").tolist() == want(x), x
        assert own.decode(own.encode(x)) == x
        if x and "<|" not in x:
            parts = bpe.segments(x, 64)
            assert "".join(t for _, t in parts) == x
            assert bpe.tree(own, [(g, bpe.ends(own, t)) for g, t in parts]) == want(x), x


def test_encode_and_decode(docs, texts):
    want = library(BYTE)
    ids = bpe.encode(docs, BYTE, segment=4096)
    got = {r.doc_id: r for r in bpe.decode(ids, BYTE).collect()}
    assert set(got) == set(range(len(texts) + 1))
    for i, x in enumerate([*texts, None]):
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want(x) and got[i].n_tokens == len(want(x)) and got[i].text == (x or "")


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.encode(none, BYTE).count() == counts.count_tokens(none, PIECE).count() == packing.pack_documents(none, WORD).count() == 0
    assert binary.pack_binary(bpe.encode(none, BYTE)).count() == 0


def test_machine_and_maps_of_chunks():
    import sentencepiece

    m, lib = counts.machine(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for x in [*ODD, *noise(150, 3)]:
        n = len(lib.encode(x))
        assert m.count(x) == n, x
        t, state, total = m.normal(x), m.start, 0
        for c in (t[i : i + 23] for i in range(0, len(t), 23)):
            end, k = m.run(c, m.start)
            state, k = m.apply(state, c, m.load(m.save(end)), k)
            total += k
        assert total == n, x


def test_states_are_compiled_anew_beyond_their_bound(monkeypatch):
    m = counts.Machine(PIECE)
    want = [m.run(m.normal(x), m.start)[1] for x in noise(20, 4)]
    monkeypatch.setattr(counts, "STATES", 50)
    other = counts.Machine(PIECE)
    assert [other.count(x) for x in noise(20, 4)] == want


def test_count_tokens(docs, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r.doc_id: r for r in counts.count_tokens(docs, PIECE, chunk=5000).collect()}
    for i, x in enumerate([*texts, None]):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((x or "").encode()), len(lib.encode(x or ""))), x


def test_word_tokens(monkeypatch):
    want = library(WORD)
    all_ = [*ODD, *noise(150, 5), None]
    assert [np.frombuffer(x, "<u4").tolist() for x in WordTokens(WORD).encode(all_)] == [want(x) for x in all_]
    monkeypatch.setattr("tessella.llm.words.REMEMBERED", 5)
    w = WordTokens(WORD)
    for x in all_:
        assert np.frombuffer(w.encode([x])[0], "<u4").tolist() == want(x)
    assert len(w) <= 5


def test_pack_documents(docs, texts):
    want = {i: [*library(WORD)(x), 0] for i, x in enumerate([*texts, None])}
    rows = packing.pack_documents(docs, WORD, capacity=64).collect()
    seen, places = {i: 0 for i in want}, {}
    for r in rows:
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.start == 64 * r.piece and r.length == len(ids) and r.ids_crc32 == zlib.crc32(ids.tobytes())
        seen[r.doc_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in want.items()}
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == np.cumsum([0, *[n for _, n in p][:-1]]).tolist() and sum(n for _, n in p) <= 64


@pytest.mark.parametrize("capacity", [8, 64, 2048])
def test_plan_is_tight_and_whole(capacity):
    rng = random.Random(capacity)
    for n in (0, 1, 7, 200, 4000):
        lengths = np.array([rng.randint(1, capacity) for _ in range(n)], np.int64)
        values, k = np.unique(lengths, return_counts=True)
        plan = packing.plan_best_two_fit(dict(zip(values.tolist(), k.tolist())), capacity)
        if not n:
            assert plan.sequences == 0
            continue
        s, o = plan.place(np.repeat(values, k), np.concatenate([np.arange(x) for x in k]))
        fill = np.bincount(s, np.repeat(values, k))
        assert len(fill) == plan.sequences and fill.max() <= capacity and (fill > 0).all()
        assert plan.sequences <= -(-11 * max(1, -(-lengths.sum() // capacity)) // 9) + 1 or (lengths > capacity // 2).sum() >= plan.sequences - 1
        assert len(set(zip(s.tolist(), o.tolist()))) == n


def test_two_replace_the_smallest():
    # greedy: 6 + 3, gap 1; then 3 gives way to 2 + 2
    plan = packing.plan_best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert sorted(plan.length[plan.sequence == plan.sequence[plan.length == 6][0]].tolist()) == [2, 2, 6]


def test_common_length_is_spread(spark):
    rows = spark.range(6000).select("id", F.lit(7).cast("long").alias("length"))
    got = packing.pack(rows, 14).groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("offset").alias("o"))
    assert got.count() == 3000 and got.where("n <> 2 or o <> 2").count() == 0


def test_lengths_out_of_range_are_refused(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 9)], "id long, length long"), 8)


def test_best_fit_takes_the_fullest_row():
    rng = random.Random(9)
    for _ in range(30):
        lengths, room, want = [rng.randint(1, 40) for _ in range(80)], [], []
        for i in sorted(range(80), key=lambda i: -lengths[i]):
            fits = [j for j in range(len(room)) if room[j] >= lengths[i]]
            if fits:
                room[min(fits, key=lambda j: room[j])] -= lengths[i]
            else:
                room.append(40 - lengths[i])
        rows = binary.best_fit_decreasing(lengths, 40)
        assert sorted(i for r in rows for i in r) == list(range(80))
        assert sorted(40 - sum(lengths[i] for i in r) for r in rows) == sorted(room)


def test_packed_binary_goes_back(docs, texts, tmp_path, spark):
    want = {i: [*library(BYTE)(x), 7] for i, x in enumerate([*texts, None])}
    rows = binary.pack_binary(bpe.encode(docs, BYTE), capacity=128, end=7, pad=9, group_ids=20_000)
    binary.write_packed(rows, str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p"))
    for r in rows.collect():
        ids, pos = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == len(pos) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids and (ids[r.n_ids :] == 9).all()
        assert pos.tolist() == [j for s in r.segments for j in range(s.length)] + [0] * (128 - r.n_ids)
    back = {}
    for r in binary.unpack(rows).collect():
        back.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r["ids"], "<u4").tolist()))
    assert {k: [i for _, x in sorted(v) for i in x] for k, v in back.items()} == want


def test_queries_agree_with_the_libraries(spark, sf):
    from tessella.llm.queries import QUERIES

    want, docs = library(BYTE), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op1_bpe"](spark, sf).collect():
        ids = np.array(want(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_long_texts_with_equal_and_null_keys(spark):
    """Rows that repeat a key, or have none, stay rows of their own however long their texts are."""
    texts = ["one two three " * 40, "four five six " * 50, "seven eight " * 60, "nine ten " * 70]
    keyed = lambda keys: spark.createDataFrame(list(zip(keys, texts)), "doc_id long, text string")
    same, apart = keyed([1, 1, None, None]), keyed([1, 2, 3, 4])
    whole = lambda df: sorted(bytes(r.ids) for r in df.collect())
    got = bpe.encode(same, BYTE, segment=100)
    assert sorted((r.doc_id is None) for r in got.collect()) == [False, False, True, True]
    assert whole(got) == whole(bpe.encode(apart, BYTE, segment=100_000))
    count = lambda df, n: sorted((r.n_bytes, r.n_tokens) for r in counts.count_tokens(df, PIECE, chunk=n).collect())
    assert count(same, 100) == count(apart, 100_000)


def test_states_stay_within_bounds(monkeypatch):
    """Texts that can't be cut at single blanks, and chunk after chunk: the tables are emptied between them and counts stay right."""
    monkeypatch.setattr(counts, "STATES", 200)
    monkeypatch.setattr(counts, "BORDERS", 300)
    import random

    import sentencepiece

    m, lib, rng = counts.Machine(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE), random.Random(1)
    text = lambda: "  ".join("".join(rng.choice("abcdeé中 ") for _ in range(rng.randint(1, 9))) for _ in range(30))
    for _ in range(40):
        x = text()
        assert m.count(x) == len(lib.encode(x))
        assert len(m.names) <= 200 + len(x) + 2
    whole, state, n = [text() for _ in range(30)], m.start, 0
    for i, x in enumerate(whole):
        state, more = m.run((m.prefix if not i else "") + x.replace(" ", counts.SPACE), state)
        n, state = n + more, m.tidy(state)
        assert len(m.names) <= 200 + len(x) + 2
    assert n == len(lib.encode("".join(whole)))


def test_maps_of_chunks_compose_in_a_tree(spark):
    """Runs of one character, whose chunks do not forget where they began, over several levels; and texts of one chunk."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = [" " * 150, "a" * 130, "ab" * 90, "=" * 101, "the of " * 30, "中é " * 40, " x" * 77, "0" * 64, "abc", "", *noise(12, 9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in counts.count_tokens(df, PIECE, chunk=7, fan=3).collect()}
    assert got == {i: len(lib.encode(x)) for i, x in enumerate(texts)}


def test_maps_hold_every_state_that_comes_in(spark):
    """A chunk's map has each end of the chunk before it, and equals a run of the text so far."""
    m, text = counts.machine(PIECE), "a" * 60 + "=" * 60
    chunks = spark.createDataFrame([(1, i, text[i * 11 : i * 11 + 11]) for i in range(-(-len(text) // 11))], "row long, seg int, text string")
    maps = {}
    for r in counts.chunk_maps(chunks, PIECE).collect():
        assert maps.setdefault((r.seg, r.came), (r.end, r.n)) == (r.end, r.n)
    state, total = m.save(m.start), 0
    for i in range(-(-len(text) // 11)):
        state, n = maps[i, state]
        total += n
        assert all((i + 1, end) in maps for (seg, _), (end, _) in maps.items() if seg == i) or i == -(-len(text) // 11) - 1
    assert total == m.run(m.normal(text), m.start)[1]
