"""Document fingerprints as invertible Bloom lookup sketches over paragraph digests.

A text is cut into paragraphs (at line ends, and at sentence ends followed by space), each becomes a 60-bit
digest, and the set of digests is folded into cells: every digest lies in one cell of each of ``TABLES`` sub-tables, and
a cell holds a count, the XOR of its digests and the XOR of their checks. Sketches of one size subtract cell by cell, so
what two versions share cancels; peeling then recovers the digests that differ, cell by cell with a single one. If that
fails the sketch was too small, and larger ones are tried: the digests are dealt to parts by their leading bits, a few
to each part, and a part that does not peel is sketched again with four times the cells. Likeness is the share of
digests that two texts have in common.

Everything is column expressions on the row of a document, in time that grows with its paragraphs, so nothing is
shuffled but the texts once, to meet the next document.

Defined results: a null text is the empty text; the empty text has no paragraphs, an all-zero sketch and likeness 1 to
another without paragraphs; equal ids are ordered by text; rows with a null id come first; a single row is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weekwatch.session import stored

#: Sub-tables, cells of each in the fingerprint, and in a part at its first attempt; digests of both texts to a part.
TABLES, CELLS, PART_CELLS, PART_DIGESTS = 3, 4, 4, 6
#: Attempts on a part, each with four times the cells; rounds of peeling.
ATTEMPTS, ROUNDS = 6, 5
#: A prime below 2^30; digests modulo it are the checks.
CHECK = 1_000_000_007
_SPAN = 12  # ids of one window: 2^12
_MARKS = "[.!?]+[ \t\r]+|[\n\r]+"


def digests(text: Column) -> Column:
    """Digests of a text's different paragraphs."""
    parts = F.array_distinct(F.filter(F.split(text, _MARKS, -1), lambda p: p != ""))
    return F.array_distinct(F.transform(parts, lambda p: F.conv(F.substring(F.md5(p), 1, 15), 16, 10).cast("long")))


def _placed(digest: str, size: int, more: str = "") -> str:
    """A digest with its check and its cell in each sub-table, the cells numbered through all sub-tables."""
    cells_of = ", ".join(f"'k{j}', CAST({j * size} + shiftright({digest}, {17 * j}) % {size} AS INT)" for j in range(TABLES))
    return f"named_struct('x', {digest}, 'c', {digest} % {CHECK}L, {cells_of}{more})"


def cells(digest_array: str, size: int) -> str:
    """SQL of the cells of a digest array, sub-table after sub-table."""
    tables = ", ".join(f"""transform(sequence({j * size}, {j * size + size - 1}), k -> aggregate(
        filter(z, e -> e.k{j} = k), named_struct('n', 0, 'x', 0L, 'c', 0L),
        (s, e) -> named_struct('n', s.n + 1, 'x', s.x ^ e.x, 'c', s.c ^ e.c)))""" for j in range(TABLES))
    return f"transform(array(transform({digest_array}, d -> {_placed('d', size)})), z -> concat({tables}))[0]"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> named_struct('n', p.n - q.n, 'x', p.x ^ q.x, 'c', p.c ^ q.c))"


def peel(cell_array: str, size: int) -> str:
    """SQL of the number of digests peeled from a difference of sketches; null if cells remain."""
    pure = (f"array_distinct(transform(filter(st.cells, s -> abs(s.n) = 1 AND s.x >= 0 AND s.c = s.x % {CHECK}L), "
            + "s -> " + _placed("s.x", size, ", 'n', s.n") + "))")
    here = " OR ".join(f"q.k{j} = i" for j in range(TABLES))
    take = f"""transform(st.cells, (s, i) -> aggregate(filter(pure, q -> {here}), s,
        (t, q) -> named_struct('n', t.n - q.n, 'x', t.x ^ q.x, 'c', t.c ^ q.c)))"""
    step = f"""transform(array({pure}), pure -> IF(size(pure) = 0, st, named_struct(
        'cells', {take}, 'found', st.found + size(pure))))[0]"""
    return f"""aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cell_array}, 'found', 0), (st, r) -> {step},
        st -> IF(exists(st.cells, s -> s.n <> 0 OR s.x <> 0 OR s.c <> 0), NULL, st.found))"""


def difference(a: str, b: str) -> str:
    """SQL of the number of digests in one array only, by sketches of growing size."""
    bits = f"CAST(greatest(0, ceil(log2(greatest(1, (size({a}) + size({b})) / {PART_DIGESTS}D)))) AS INT)"
    bound = f"""transform(array({bits}), k -> named_struct('outer', sequence(0, shiftleft(1, k div 2) - 1), 'far', 60 - k div 2,
        'inner', sequence(0, shiftleft(1, k - k div 2) - 1), 'near', 60 - k, 'mask', CAST(shiftleft(1, k - k div 2) - 1 AS BIGINT)))"""
    outer = "transform(v.outer, g -> named_struct(" + ", ".join(
        f"'{n}', filter({x}, d -> shiftright(d, v.far) = g)" for n, x in (("a", a), ("b", b))) + "))"
    inner = f"flatten(transform({outer}, o -> transform(v.inner, h -> named_struct(" + ", ".join(
        f"'{n}', filter(o.{n}, d -> (shiftright(d, v.near) & v.mask) = h)" for n in "ab") + "))))"
    tries = ", ".join(peel(subtract(cells("p.a", PART_CELLS * 4**k), cells("p.b", PART_CELLS * 4**k)), PART_CELLS * 4**k)
                      for k in range(ATTEMPTS))
    total = f"aggregate({inner}, 0, (total, p) -> total + coalesce({tries}, size(p.a) + size(p.b)))"
    return f"transform({bound}, v -> {total})[0]"


def likeness(a: str, b: str, sketch_a: str, sketch_b: str) -> Column:
    """1 less the share of digests that differ: the fingerprints are subtracted first, then larger sketches."""
    d = f"coalesce({peel(subtract(sketch_a, sketch_b), CELLS)}, {difference(a, b)})"
    return F.expr(f"CASE WHEN size({a}) + size({b}) = 0 THEN 1D ELSE 1 - {d} / CAST(size({a}) + size({b}) AS DOUBLE) END")


def written(sketch: str) -> Column:
    """A sketch as hex digits: count, digests and checks of each cell."""
    return F.expr(f"array_join(transform({sketch}, s -> concat(lpad(hex(s.n), 4, '0'), lpad(hex(s.x), 16, '0'), "
                  "lpad(hex(s.c), 8, '0'))), '')")


def _following(keys: DataFrame) -> DataFrame:
    """``(k, next_k)`` of different numbers ``k``; the largest gets null. Windows hold at most 2^12 rows."""
    if keys.count() <= 1 << _SPAN:
        return keys.withColumn("next_k", F.lead("k").over(W.orderBy("k")))
    part = F.shiftright("k", _SPAN)
    inside = keys.withColumn("b", part).withColumn("next_k", F.lead("k").over(W.partitionBy("b").orderBy("k")))
    firsts = stored(inside.groupBy("b").agg(F.min("k").alias("first")))
    after = _following(firsts.select(F.col("b").alias("k"))).withColumnRenamed("k", "b").withColumnRenamed("next_k", "nb")
    jump = after.join(firsts.select(F.col("b").alias("nb"), F.col("first").alias("jump")), "nb", "left").select("b", "jump")
    return inside.join(jump, "b", "left").select("k", F.coalesce("next_k", "jump").alias("next_k"))


def with_next(df: DataFrame, id_column: str = "doc_id", text: str = "text", more=lambda rows: rows) -> DataFrame:
    """``(id, text, next_text)``: each text with that of the next id; after the last comes the first.

    Columns that ``more`` adds to ``text`` come along, those of the next row under ``next_`` and their name.

    Ids are dealt to windows of 2^12 consecutive numbers; the first text of a window is looked up for the last of the
    window before.
    """
    rows = df.select(F.col(id_column), F.coalesce(F.col(text), F.lit("")).alias("text"),
                     F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63))).alias("k")).withColumn(
        "b", F.shiftright("k", _SPAN))
    plain, rows = rows, more(rows)
    own = ["text", *(c for c in rows.columns if c not in plain.columns)]
    firsts = stored(plain.groupBy("b").agg(F.min("k").alias("k")))
    heads = more(plain.select("k", "text").join(firsts.select("k"), "k").groupBy("k").agg(F.min("text").alias("text")))
    order = _following(firsts.select(F.col("b").alias("k"))).select(F.col("k").alias("b"), F.col("next_k").alias("nb"))
    lowest = firsts.agg(F.min("b").alias("lowest"))
    start = lowest.first()[0]
    named = firsts.join(heads, "k").select(F.col("b").alias("nb"), F.struct(*own).alias("head"))
    heads_of = order.withColumn("nb", F.coalesce("nb", F.lit(start))).join(named, "nb").select("b", "head")
    w = W.partitionBy("b").orderBy("k", "text")
    led = rows.withColumn("_next", F.lead(F.struct(*own)).over(w))
    following = F.coalesce("_next", "head")
    return led.join(heads_of, "b").select(id_column, *own, *[following[c].alias(f"next_{c}") for c in own])


def fingerprint_edits(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edit, whose last quarter is the beginning of the next text, with the
    likeness of the fingerprint to that of the edit and of the next text."""
    quarter = F.expr("CAST(length(text) div 4 AS INT)")
    edited = F.concat(F.expr("substring(text, 1, length(text) - CAST(length(text) div 4 AS INT))"),
                      F.substring("next_text", F.lit(1), quarter))
    sketch = lambda rows: rows.withColumn("a", digests(F.col("text"))).withColumn("sa", F.expr(cells("a", CELLS)))
    rows = with_next(df, id_column, text, sketch).withColumn("edited", edited).select(
        id_column, F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "a", "sa", digests(F.col("edited")).alias("e"), F.col("next_a").alias("x"), F.col("next_sa").alias("sx"))
    sketched = rows.withColumn("se", F.expr(cells("e", CELLS)))
    return sketched.select(
        id_column, "n_chars", "edited_sha256", written("sa").alias("fingerprint"), written("se").alias("edited_fingerprint"),
        likeness("a", "e", "sa", "se").alias("near_edited"), likeness("a", "x", "sa", "sx").alias("near_next"))


def oracle() -> str:
    """DuckDB SQL for ``fingerprint_edits`` of ``documents``; likeness comes from the digest sets themselves."""
    cell = "((d // (1::BIGINT << (17 * j)::INTEGER)) % {})".format(CELLS)
    split = r"string_split_regex({}, '[.!?]+[ \t\r]+|[\n\r]+')"
    digest = "list_distinct([('0x' || substr(md5(p), 1, 15))::BIGINT FOR p IN {} IF p <> ''])"
    sets = ", ".join(f"{digest.format(split.format(c))} AS {n}" for n, c in (("a", "text"), ("e", "edited"), ("x", "nxt")))
    near = "CASE WHEN len(a) + len({0}) = 0 THEN 1.0::DOUBLE ELSE 1 - (len(a) + len({0}) - 2 * len(list_intersect(a, {0})))" \
           " / (len(a) + len({0}))::DOUBLE END"
    return f"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS text,
    coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id), '') AS nxt FROM documents),
m AS (SELECT *, left(text, length(text) - length(text) // 4) || left(nxt, length(text) // 4) AS edited FROM o),
s AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {sets} FROM m),
u AS (SELECT doc_id, 'a' AS w, unnest(a) AS d FROM s UNION ALL SELECT doc_id, 'e', unnest(e) FROM s),
c AS (SELECT doc_id, w, j, {cell} AS k, count(*) AS n, bit_xor(d) AS x, bit_xor(d % {CHECK}) AS c
    FROM u, generate_series(0, {TABLES - 1}) t(j) GROUP BY ALL),
g AS (SELECT doc_id, w, j, k FROM s, (VALUES ('a'), ('e')) v(w), generate_series(0, {TABLES - 1}) t(j),
    generate_series(0, {CELLS - 1}) r(k)),
f AS (SELECT doc_id, w, string_agg(printf('%04X%016X%08X', coalesce(n, 0), coalesce(x, 0), coalesce(c, 0)), ''
    ORDER BY j, k) AS fp FROM g LEFT JOIN c USING (doc_id, w, j, k) GROUP BY ALL)
SELECT s.doc_id, n_chars, edited_sha256, fa.fp AS fingerprint, fe.fp AS edited_fingerprint,
    {near.format('e')} AS near_edited, {near.format('x')} AS near_next
FROM s JOIN f fa ON fa.doc_id = s.doc_id AND fa.w = 'a' JOIN f fe ON fe.doc_id = s.doc_id AND fe.w = 'e'"""
