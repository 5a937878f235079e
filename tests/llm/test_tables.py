"""Spelling variants, Merkle manifest and Hilbert shards against brute force, and their odd cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import manifest, sharding, spelling
from tessella.llm.positions import positions

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, leaf string, shard string, size string, pos string, n_group string, g string, d string"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source, n_chars) with extra columns named like results and work columns."""
    return spark.createDataFrame([(*r, "w", "l", "s", "z", "p", "n", "g", "d") for r in rows], DOCS).repartition(3)


# -- positions ------------------------------------------------------------------------------------


def test_positions(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, ""]), rng.choice([None, 1, 2, 2, 2, 9]), rng.randint(0, 5)) for _ in range(400)]
    rows += [("hot", 7, 1)] * 500  # one value of the order for most rows
    df = spark.createDataFrame(rows, "grp string, k long, s long").repartition(5)
    got = positions(df, ["grp"], ["k"], "s").collect()
    assert len(got) == len(rows) and Counter((r.grp, r.k, r.s) for r in got) == Counter(rows)
    for name in {r[0] for r in rows}:
        own = sorted((r for r in got if r.grp == name), key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(len(own))) and {r.n_group for r in own} == {len(own)}
        keys = [(r.k is not None, r.k or 0) for r in own]
        assert keys == sorted(keys)
        assert [r.ahead for r in own] == [sum(x.s for x in own[:i]) for i in range(len(own))]
    assert positions(df.where("false"), ["grp"], ["k"], "s").count() == 0


# -- spelling ---------------------------------------------------------------------------------------


def brute_words(rows, least=7, times=2):
    n = Counter()
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= times}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute_variants(vocab):
    near = {w: [v for v in vocab if one_apart(w, v)] for w in vocab}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 10 * vocab[w] else None
    out = set()
    for w in vocab:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, vocab[w], len(near[w]), vocab[form[w]] if form[w] else None))
    return out


def spelling_rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcéÿ") for _ in range(rng.randint(6, 9))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaab", "z" * 400]
    rows = []
    for i in range(60):
        words = []
        for _ in range(60):
            w = rng.choice(base[: 4 + i % 24])
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abdé") + w[at + 1 :], w[:at] + rng.choice("abd") + w[at:]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i, rng.choice([" ", "-", "中", "1"]).join(words), "en", "s", 1))
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (None, "Nullkey nullkey nullkey", "en", "s", 0), (5, rows[5][1], "en", "s", 1)]
    return [*rows, (102, "commonword " * 3000 + "commonwrd commonwrd comonwrd comonwrd", "en", "s", 9)] + [(103, "commonwrd " * 30, "en", "s", 9)]


def test_spelling_variants(spark):
    rows = spelling_rows()
    vocab = brute_words(rows)
    want = brute_variants(vocab)
    got = {tuple(r) for r in spelling.spelling_variants(frame(spark, rows)).collect()}
    assert got == want
    assert any(f and r != f for _, f, r, *_ in want) and any(n > 3 for *_, n, _ in want)


def test_spelling_in_passes(spark, monkeypatch):
    """Filters that don't fit one pass give the same pairs."""
    vocab = brute_words(spelling_rows())
    words = spark.createDataFrame(sorted(vocab.items()), "word string, n long")
    monkeypatch.setattr(spelling, "SENT_BYTES", 64)
    assert sum(s for _, s in spelling.stretches(Counter(map(len, vocab))).values()) * 8 > 3 * 64
    got = {(r.word, r.near) for r in spelling.near_pairs(words).collect()}
    assert got == {(a, b) for a in vocab for b in vocab if one_apart(a, b)}


def test_edits_find_their_words():
    """Every edit of every word is generated once, whatever the filters hold beside."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(n)) for n in (4, 5, 6) for _ in range(60)})
    where = spelling.stretches(Counter(map(len, words)))
    full = np.full(sum(s for _, s in where.values()), ~np.uint64(0))
    alphabet = np.frombuffer(b"abc", np.uint8)
    for w in words[:40]:
        made = [w[:p] + (chr(c) if c >= 0 else "") + w[p + 1 :] for _, ps, cs in spelling.edits_in(np.frombuffer(w.encode(), np.uint8)[None], full, 0, where, alphabet) for p, c in zip(ps.tolist(), cs.tolist())]
        larger = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abc" if c > w[i]}
        shorter = {w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) - 1 in where else set()
        assert len(made) == len(set(made)) and set(made) == larger | shorter


def test_spelling_of_nothing(spark):
    out = spelling.spelling_variants(frame(spark, [(1, None, None, None, None)]))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0
    assert spelling.spelling_variants(frame(spark, []).where("false")).count() == 0


# -- manifest ---------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes, fan):
    """(root, siblings of each leaf)."""
    proofs, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        made, owners = [], []
        for i in range(0, len(nodes), fan):
            run = nodes[i : i + fan]
            for j in range(len(run)):
                for k in at[i + j]:
                    proofs[k].append((run[:j], run[j + 1 :]))
            made.append(sha(*run))
            owners.append(sum(at[i : i + fan], []))
        nodes, at = made, owners
    return nodes[0], proofs


def brute_manifest(rows, fan=16):
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for doc, text, lang, source, n in rows:
        leaf = leaf_of(doc, source, lang, n, text)
        hit = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        groups.setdefault(source, []).append((doc is not None, doc or 0, leaf, leaf_of(doc, source, lang, n, low(text)) if hit else leaf, doc))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in names:
        groups[s].sort()
        subs[s] = brute_tree([x[2] for x in groups[s]], fan)
    root, above = brute_tree([subs[s][0] for s in names], fan)
    out = []
    for i, s in enumerate(names):
        for x, proof in zip(groups[s], subs[s][1]):
            proof, fold = proof + above[i], x[3]
            for left, right in proof:
                fold = sha(*left, fold, *right)
            out.append((x[4], x[2], subs[s][0], root, sha(*(y for left, right in proof for y in [*left, *right])), fold, fold == root))
    return out


def manifest_rows():
    rng = random.Random(8)
    rows = [(i, rng.choice(["Some TEXT", "lower", "ÉtÉ Z", "", None, "X" * 50_000]), rng.choice(["en", None]), "hot", rng.choice([1, None])) for i in rng.sample(range(-3, 900), 600)]
    rows += [(i, f"Text {i}", "de", f"s{i % 23}", i) for i in range(1000, 1100)] + [(2000, "Lone", "de", "lone", 1), (2001, None, None, None, None), (2002, "A", "x", "", 2)]
    return rows + [rows[0], rows[0], (rows[1][0], "Other", "en", "hot", 1), (None, "Null KEY", "en", "hot", 1), (None, None, None, "hot", None)]


@pytest.mark.parametrize("fan", [16, 5])
def test_manifest(spark, fan, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK_RUNS", 2)  # windows over parts of a group
    rows = manifest_rows() if fan == 16 else manifest_rows()[550:]
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    out = manifest.manifest(frame(spark, rows), changed={"text": manifest.lowered(F.col("text"))}, where=hit, fan=fan)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got, want = sorted(map(tuple, out.collect()), key=repr), sorted(brute_manifest(rows, fan), key=repr)
    assert got == want
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_little(spark):
    assert manifest.manifest(frame(spark, []).where("false")).count() == 0
    (r,) = manifest.manifest(frame(spark, [(7, "x", None, None, 1)])).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == leaf_of(7, None, None, 1, "x") and r.proof_sha256 == sha() and r.verified


# -- shards -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (1, 3), (4, 2)])
def test_hilbert_index(spark, axes, bits):
    """A bijection whose neighbours on the curve are neighbours in the grid."""
    cells = list(itertools.product(range(1 << bits), repeat=axes))
    names = [f"a{i}" for i in range(axes)]
    got = spark.createDataFrame(cells, names).select("*", sharding.hilbert_index([F.col(n) for n in names], bits).alias("at")).collect()
    by = {r["at"]: r[:axes] for r in got}
    assert sorted(by) == list(range(len(cells)))
    assert all(sum(abs(x - y) for x, y in zip(by[i], by[i + 1])) == 1 for i in range(len(cells) - 1))


def shard_rows():
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "éé", "", None, "word " * 40]), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", f"s{rng.randint(0, 30)}", None]), rng.randint(0, 2000)) for i in range(997)]
    return rows + [rows[3], rows[3], (None, "x", None, None, None), (None, "y" * 9000, None, "hot", 9000)]


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, law):
    rows = shard_rows()
    sharded = sharding.shard_documents(frame(spark, rows), law=law)
    got = sharded.collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((x[0], size(x[1]), zlib.crc32((x[1] or "").encode())) for x in rows)
    assert all(r.law == law and r.grown_shard is None for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(8)) or law == "bytes" and set(by) < set(range(8))  # one long text may span a shard
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    if law == "rows":
        assert {len(x) for x in by.values()} <= {len(rows) // 8, len(rows) // 8 + 1}
    else:
        each = [sum(r.size for r in x) for x in by.values()]
        assert max(abs(x - sum(each) / 8) for x in each) <= max(r.size for r in got)
    ranges = sharding.shard_ranges(sharded).collect()
    assert sum(r.rows for r in ranges) == len(rows) and sum(r.bytes for r in ranges) == sum(r.size for r in got)
    for r in ranges:
        values = [x.d2 for x in by[r.shard] if x.d2 is not None]
        assert (r.low_d2, r.high_d2) == (min(values), max(values))


def test_shards_prune_every_dimension(spark):
    """Filters on either of two columns leave out most shards, as no order by one column does."""
    rng = random.Random(6)
    rows = [(i, "t", f"l{rng.randint(0, 31):02}", f"s{rng.randint(0, 31):02}", 1) for i in range(4000)]
    ranges = sharding.shard_ranges(sharding.shard_documents(frame(spark, rows), ("source", "lang"), shards=16)).collect()
    for d, letter in (("d0", "s"), ("d1", "l")):
        read = [sum(r[f"low_{d}"] <= f"{letter}{v:02}" <= r[f"high_{d}"] for r in ranges) for v in range(32)]
        assert sum(read) / 32 <= 6  # of 16; rows in shards by the other column alone would all be read


def test_shards_of_little(spark):
    assert sharding.shard_documents(frame(spark, []).where("false")).count() == 0
    got = sharding.shard_documents(frame(spark, [(i, None, None, None, None) for i in range(5)])).collect()
    assert sorted(r.shard for r in got) == list(range(5)) and all(r.slot == 0 and r.size == 1 and r.text_crc32 == 0 for r in got)
    with pytest.raises(ValueError):
        sharding.shard_documents(frame(spark, []), law="key")
