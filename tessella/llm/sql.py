"""DuckDB SQL of the queries that SQL can express."""

BLANKS = r"\x20\x09-\x0D"

OP4 = rf"""
WITH w AS (SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^{BLANKS}]+') AS ws FROM documents),
grams AS (
  SELECT doc_id, i, ws[i] || chr(9) || ws[i + 1] || chr(9) || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
  WHERE regexp_matches(line, '[^{BLANKS}]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(coalesce(text, ''), '[{BLANKS}]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN hit USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(bad / n) AS mean, CASE WHEN var_samp(bad / n) > 0 THEN least(1000.0, greatest(1.0, avg(bad / n) * (1 - avg(bad / n)) / var_samp(bad / n) - 1)) ELSE 1000.0 END AS k FROM h),
v AS (SELECT source, (bad + k * mean) / (n + k) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rate > 0.5, false) AS kept
FROM f LEFT JOIN v USING (source)
"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, r::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20
"""

OP10 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{BLANKS}]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(ws[i:i + 4], chr(9)) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
e AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON e.a = r.to_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(to_id) AS c FROM reach GROUP BY doc_id) c USING (doc_id)
"""


def _crc_table() -> list[int]:
    """The checksum's step for each byte, from its polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in table]
    return table


def crc32(bytes_: str) -> str:
    """SQL for the unsigned crc32 of a list of byte values."""
    table = "[" + ", ".join(f"{x}::BIGINT" for x in _crc_table()) + "]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, {table}[((xor(c, b)) & 255) + 1])), 4294967295)"


#: Lists of byte values: of digits and ASCII, of text of code points below 256, of any text.
ASCII_BYTES = "list_transform(string_split({0}, ''), lambda x: unicode(x)::BIGINT)"
LATIN_BYTES = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))"
ANY_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: ('0x' || x)::BIGINT)"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11 = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
hashed AS (SELECT w, {crc32(LATIN_BYTES.format("doc_id::VARCHAR || ':' || w"))} AS h FROM runs WHERE length(w) >= 7),
kept AS (SELECT CASE WHEN h % 31 = 0 THEN w[1:(h % length(w))::INTEGER] || w[(h % length(w))::INTEGER + 2:] ELSE w END AS word FROM hashed),
vocab AS (SELECT word, count(*) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
spots AS (SELECT word, n, unnest(range(1, length(word)::BIGINT + 1)) AS i FROM vocab),
cut AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM spots),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, v.word, v.n FROM cut a JOIN vocab v ON v.word = a.rest
  UNION SELECT v.word, v.n, a.word, a.n FROM cut a JOIN vocab v ON v.word = a.rest),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
forms AS (
  SELECT p.word, min(p.near) AS form, min(p.near_n) AS form_n FROM pairs p JOIN best b ON b.word = p.word AND b.top = p.near_n WHERE p.near_n >= 10 * p.n GROUP BY p.word),
walk(word, top) AS (SELECT word, word FROM vocab UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.top)
SELECT v.word, f.form, w.top AS root, v.n::BIGINT AS n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM vocab v JOIN walk w ON w.word = v.word AND w.top NOT IN (SELECT word FROM forms) LEFT JOIN best b ON b.word = v.word LEFT JOIN forms f ON f.word = v.word
"""


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"


def merkle(levels: int = 7) -> str:
    """SQL of the manifest for up to 16 ** (levels - 1) rows in a source and sources."""
    leaf = lambda text: "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [f"""leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, {leaf("text")} AS d,
    CASE WHEN {crc32(ASCII_BYTES.format("doc_id::VARCHAR"))} % 5 = 0 THEN {leaf(low)} ELSE {leaf("text")} END AS now FROM documents),
a0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id, d) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, d, doc_id, now FROM leaves)"""]
    for t, top in (("a", "b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, d, g AS name FROM atop)"), ("b", None)):
        for i in range(1, levels):
            parts.append(f"{t}{i} AS (SELECT g, pos // 16 AS pos, (any_value(n) + 15) // 16 AS n, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM {t}{i - 1} WHERE n > 1 GROUP BY g, pos // 16)")
        parts.append(f"{t}top AS (" + " UNION ALL ".join(f"SELECT g, d FROM {t}{i} WHERE n = 1" for i in range(levels)) + ")")
        for i in range(levels):
            parts.append(f"{t}s{i} AS (SELECT x.g, x.pos, coalesce(string_agg(y.d, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l, coalesce(string_agg(y.d, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r FROM {t}{i} x JOIN {t}{i} y ON x.g = y.g AND x.pos // 16 = y.pos // 16 WHERE x.n > 1 GROUP BY x.g, x.pos)")
        if top:
            parts.append(top)
    at, before = "p", "SELECT a0.doc_id, a0.g, a0.pos, a0.d AS leaf, b0.pos AS gpos, b0.d AS subroot, btop.d AS root, a0.now AS fold, '' AS proof FROM a0 JOIN b0 ON b0.name = a0.g, btop"
    parts.append(f"{at} AS ({before})")
    for t, g, pos in (("a", "p.g", "p.pos"), ("b", "''", "p.gpos")):
        for i in range(levels):
            parts.append(f"{t}p{i} AS (SELECT p.* EXCLUDE (fold, proof), CASE WHEN s.l IS NULL THEN p.fold ELSE sha256(s.l || p.fold || s.r) END AS fold, p.proof || coalesce(s.l || s.r, '') AS proof FROM {at} p LEFT JOIN {t}s{i} s ON s.g = {g} AND s.pos = {pos} // {16**i})")
            at = f"{t}p{i}"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM {at}"


OP12 = merkle()


def hilbert(axes: list[str], bits: int, source: str) -> tuple[str, str]:
    """CTEs that add the place on the curve, `curve`, to `source`, and the name of the last; rows are kept, with work columns."""
    x = [f"h{i}" for i in range(len(axes))]
    ctes, at = [], source

    def step(new: dict[str, str]) -> None:
        nonlocal at
        name = f"hs{len(ctes)}"
        have = "* REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in new.items()) + ")" if ctes else "*, " + ", ".join(f"{e} AS {c}" for c, e in new.items())
        ctes.append(f"{name} AS (SELECT {have} FROM {at})")
        at = name

    step(dict(zip(x, axes)))
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for c in x:
            on, t = f"({c} & {1 << b}) <> 0", f"(xor({x[0]}, {c}) & {low})"
            step({x[0]: f"CASE WHEN {on} THEN xor({x[0]}, {low}) ELSE xor({x[0]}, {t}) END"} | ({c: f"CASE WHEN {on} THEN {c} ELSE xor({c}, {t}) END"} if c != x[0] else {}))
    for a, c in zip(x, x[1:]):
        step({c: f"xor({c}, {a})"})
    flip = "0"
    for b in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN ({x[-1]} & {1 << b}) <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    step({c: f"xor({c}, {flip})" for c in x})
    places = [f"((({c} >> {b}) & 1) << {len(x) * b + len(x) - 1 - i})" for b in range(bits) for i, c in enumerate(x)]
    ctes.append(f"curved AS (SELECT *, {' + '.join(places)} AS curve FROM {at})")
    return ",\n".join(ctes), "curved"


_AXES = ("source", "lang", "n_chars")
_BINS = ",\n".join(f"bin_{c} AS (SELECT v, CASE WHEN v IS NULL THEN 0 ELSE ((sum(n) OVER (ORDER BY v NULLS FIRST) - n) * 32) // sum(n) OVER () END::BIGINT AS b FROM (SELECT {c} AS v, count(*) AS n FROM documents GROUP BY {c}))" for c in _AXES)
_CURVE, _LAST = hilbert([f"d_{c}" for c in _AXES], 5, "light")
OP13 = f"""
WITH {_BINS},
light AS (
  SELECT doc_id, (coalesce(octet_length(encode(text)), 0) + 1)::BIGINT AS size, {crc32(ANY_BYTES.format("coalesce(text, '')"))}::BIGINT AS text_crc32,
    {", ".join(f"bin_{c}.b AS d_{c}" for c in _AXES)}
  FROM documents {" ".join(f"JOIN bin_{c} ON bin_{c}.v IS NOT DISTINCT FROM {c}" for c in _AXES)}),
{_CURVE},
placed AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id, size, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM {_LAST}),
cut AS (SELECT *, (CASE WHEN pos < (n // 8 + 1) * (n % 8) THEN pos // (n // 8 + 1) ELSE n % 8 + (pos - (n // 8 + 1) * (n % 8)) // (n // 8) END)::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, (pos - min(pos) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM cut
"""
