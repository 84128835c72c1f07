"""Readers of text and of positions over the supplied tables, whose rows are written out as the texts of a tender.

Each query writes a few wordings with the numbers and names of a row in them and reads them back; its SQL states what has
to come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions import text as X
from girder.functions import wording as W
from girder.operators import documents, drawing, layout_text, metrics, versions
from girder.plans.registry import query
from girder.sources import files
from girder.sources.tables import table


def wording(key: Column, *texts) -> Column:
    """The text of several that a row's number picks; a tuple's parts are joined, strings in it are literal."""
    lit = lambda t: F.lit(t) if isinstance(t, str) else t.cast("string")
    made = [F.concat(*map(lit, t)) if isinstance(t, tuple) else F.lit(t) for t in texts]
    return F.element_at(F.array(*made), (key % len(made)).cast("int") + 1)


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 1 THEN p_size + 50 WHEN 3 THEN p_size + 50 END AS dn_min, CASE p_partkey % 7 WHEN 0 THEN p_size + 50 WHEN 2 THEN p_size + 50 WHEN 6 THEN p_size + 50 END AS dn_max FROM part""")
def size_ranges(spark, sf_dir) -> DataFrame:
    """Sizes up to and from a limit; both in one sentence give none."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_size") + 50
    said = wording(
        F.col("p_partkey"), ("Pipes up to DN ", n, " are threaded."), ("DN", n, " and above is grooved."), ("Sizes not exceeding ", n, " mm"),
        ("Pipes ≥ DN ", n, " are welded"), ("Up to DN ", n, " and DN ", n, " and over"), (F.col("p_name"), " throughout"), ("pipes ≤ ", n),
    )
    low, high = X.size_range(said)
    return p.select("p_partkey", low.alias("dn_min"), high.alias("dn_max"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1000 + p_size * 100 WHEN 1 THEN 600 + p_size WHEN 3 THEN 2000 + p_size END AS spacing FROM part""")
def spacings(spark, sf_dir) -> DataFrame:
    """Spacings in metres or millimetres; what is under half a metre is none."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    metres = F.concat(F.floor((size + 10) / 10).cast("string"), F.lit("."), (size % 10).cast("string"))
    said = wording(F.col("p_partkey"), ("Hangers at ", metres, " m centres"), ("every ", size + 600, " mm"), ("a gap of ", size, " mm"), ("Spacing ", size + 2000, "mm at most"), (F.col("p_name"), ""))
    return p.select("p_partkey", X.spacing_mm(said).alias("spacing"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey + 1000 WHEN 1 THEN o_custkey + 0.5 WHEN 2 THEN o_custkey END::DOUBLE AS amount,
CASE o_orderkey % 4 WHEN 0 THEN 'SGD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' END AS currency FROM orders""")
def stated_amounts(spark, sf_dir) -> DataFrame:
    """Amounts without their separators, and currencies by code or by the sign before a digit."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey")
    grouped = F.format_number(k + 1000, 0)
    said = wording(F.col("o_orderkey"), ("S$ ", grouped, " nett"), ("total eur ", k, ".50 only"), ("US$", k), "by others")
    return o.select("o_orderkey", X.money_in(said).cast("double").alias("amount"), X.currency_in(said).alias("currency"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def stated_dates(spark, sf_dir) -> DataFrame:
    """Dates in the first of several formats that fits."""
    o = table(spark, sf_dir, "orders")
    said = wording(F.col("o_orderkey"), *[(F.date_format("o_orderdate", f), "") for f in ("yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy")], "to be advised")
    return o.select("o_orderkey", X.date_in(said, "yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy").alias("day"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 20 + p_size WHEN 1 THEN 20 + p_size WHEN 2 THEN 20 + p_size WHEN 3 THEN 50 WHEN 4 THEN 40 END AS dn FROM part""")
def label_sizes(spark, sf_dir) -> DataFrame:
    """Nominal sizes of pipe labels in millimetres or inches."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_size") + 20
    return p.select("p_partkey", X.pipe_size(wording(F.col("p_partkey"), ("DN", n), ("Ø ", n, " pipe"), (n, " mm"), '2" pipe', '1 1/2" drop', (F.col("p_name"), ""))).alias("dn"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'P' WHEN 1 THEN 'C' WHEN 4 THEN NULL ELSE '' END AS series,
CASE c_custkey % 5 WHEN 0 THEN c_custkey % 40 WHEN 1 THEN c_custkey % 40 WHEN 2 THEN 1 + c_custkey % 26 WHEN 3 THEN c_custkey % 90 END::INTEGER AS number FROM customer""")
def revision_labels(spark, sf_dir) -> DataFrame:
    """Series and number of revision labels; letters alone count as numbers."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    series, number = X.revision(wording(k, ("Rev P", k % 40), ("c", k % 40), (F.char(65 + k % 26), ""), (k % 90, ""), "as built"))
    return c.select("c_custkey", series.alias("series"), number.alias("number"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'R0' || c_custkey % 9 WHEN 1 THEN 'B' WHEN 3 THEN 'AB' WHEN 5 THEN 'C' || c_custkey % 90 END AS label FROM customer""")
def file_revisions(spark, sf_dir) -> DataFrame:
    """Revision labels in file names, after the drawing's number."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    number = F.concat(F.lit("FP-L05-"), (k + 100).cast("string"))
    plain = F.concat(F.lit("FP_L05_"), (k + 100).cast("string"))
    name = wording(k, (number, "-R0", k % 9, ".pdf"), (plain, " Rev B.dwg"), (number, "0-A.pdf"), ("A ", plain, " (AB).pdf"), (number, "-AB.pdf"), (plain, "_rev", "C", k % 90, " final.pdf"))
    return c.select("c_custkey", X.file_revision(name, number).alias("label"))


@query("""SELECT n_nationkey, c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'plan' WHEN 1 THEN 'section' WHEN 2 THEN 'schematic' WHEN 3 THEN 'detail' END AS kind FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def view_kinds(spark, sf_dir) -> DataFrame:
    """Kinds of views by a word of their titles (titles made of customers' keys)."""
    c = table(spark, sf_dir, "customer").withColumn("n_nationkey", F.col("c_nationkey"))
    k = F.col("c_custkey")
    title = wording(k, ("Level ", k, " LAYOUT"), ("Section ", F.char(65 + k % 26), "-A"), ("Riser diagram ", k), ("TYPICAL DETAIL ", k), ("Notes ", k))
    return c.select("n_nationkey", "c_custkey", X.view_kind(title).alias("kind"))


@query("""SELECT p_partkey, p_partkey % 6 IN (0, 1, 4) AS asked FROM part""")
def clause_duties(spark, sf_dir) -> DataFrame:
    """Whether a clause asks for a test header itself, or only names it in passing."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_size")
    said = wording(
        F.col("p_partkey"), ("A ", n, " mm test header shall be provided."), ("The contractor shall provide one brass test header, size ", n), ("Supply to the test header shall be provided by others, see ", n),
        ("The test header will be painted in ", n, " coats."), ("Each test header must also be installed within ", n, " m."), ("Pumps shall be provided: ", n),
    )
    return p.select("p_partkey", X.requires(said, "test header").alias("asked"))


@query("""SELECT doc_id, list_has_all(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ['the', 'of', 'and']) AS cited FROM documents WHERE text IS NOT NULL""")
def citations_checked(spark, sf_dir) -> DataFrame:
    """Whether the words of a value stand in the text that is cited for it."""
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", X.cites(F.col("text"), F.lit("Of the; and THE")).alias("cited"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '10' || c_custkey WHEN 1 THEN '11' || c_custkey WHEN 2 THEN 'FLOOR' ELSE c_custkey || '00' END AS digits FROM customer""")
def repaired_digits(spark, sf_dir) -> DataFrame:
    """Letters that a reader took for digits next to them."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", documents.ocr_digits(wording(k, ("1O", k), ("Il", k), "FLOOR", (k, "OO"))).alias("digits"))


@query("""SELECT o_orderkey, 'pays [amount] and [amount] for ' || o_custkey AS note, '[hidden] (' || length(o_orderpriority) || ' characters)' AS clerk FROM orders""")
def scrubbed_fields(spark, sf_dir) -> DataFrame:
    """What may leave the engine: amounts are masked under known keys, and all text under others."""
    o = table(spark, sf_dir, "orders")
    note = F.concat(F.lit("pays S$ 1,2"), (F.col("o_custkey") % 90 + 10).cast("string"), F.lit(".50 and 7.25 for "), F.col("o_custkey").cast("string"))
    fields = X.scrubbed(F.create_map(F.lit("note"), note, F.lit("clerk"), F.col("o_orderpriority")), ["note"])
    return o.select("o_orderkey", fields["note"].alias("note"), fields["clerk"].alias("clerk"))


@query("""WITH s AS (SELECT p_partkey, ['block_hash', 'vision', 'shape'][p_partkey % 3 + 1] AS method, p_size / 97.0::DOUBLE AS d, p_type = 'PROMO' AS equipment, p_partkey % 2 = 0 AS connected FROM part),
m AS (SELECT *, CASE method WHEN 'block_hash' THEN 1.0 WHEN 'vision' THEN 0.5 ELSE greatest(0.0, 1.0 - 0.5 * d / 0.4) END::DOUBLE * CASE WHEN connected THEN 1.0 WHEN equipment THEN 0.85 ELSE 0.55 END::DOUBLE AS raw FROM s)
SELECT p_partkey, round(raw, 4) AS score FROM m""")
def symbol_scores(spark, sf_dir) -> DataFrame:
    """How sure a symbol is, by how it was found and whether it is on the pipework."""
    p = table(spark, sf_dir, "part")
    method = wording(F.col("p_partkey"), "block_hash", "vision", "shape")
    score = drawing.symbol_score(method, F.col("p_size") / 97, F.lit(0.4), F.col("p_type") == "PROMO", F.col("p_partkey") % 2 == 0)
    return p.select("p_partkey", score.alias("score"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_partkey % 11 WHEN 0 THEN 'plan' WHEN 1 THEN 'enlarged plan' WHEN 2 THEN 'section' WHEN 3 THEN 'plan' WHEN 4 THEN 'schematic' WHEN 6 THEN 'key plan' WHEN 8 THEN 'detail' WHEN 10 THEN 'elevation' END AS view,
CASE WHEN l_partkey % 11 IN (0, 10) THEN CAST(l_linenumber AS VARCHAR) WHEN l_partkey % 11 = 1 THEN 'B' || l_linenumber WHEN l_partkey % 11 = 3 THEN CAST(l_linenumber + 3 AS VARCHAR) END AS level FROM lineitem""")
def view_titles(spark, sf_dir) -> DataFrame:
    """Kinds and levels of views by their titles; notes and sentences that have a title's words are none."""
    i, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    title = wording(
        F.col("l_partkey"), ("LEVEL ", n, " SPRINKLER LAYOUT"), ("Enlarged plan of pump room ", n, " at lvl B", n), "SECTION A-A", (n + 3, "TH STOREY PLAN"), ("Riser diagram ", n), (n, ". Plans are indicative"),
        "KEY PLAN", "Read with the detail drawings. Sizes are nominal", ("TYPICAL DETAILS ", n), "PLANT ROOM", ("Level ", n, " - elevation"),
    )
    view, level = W.view_of(title)
    return i.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", view.alias("view"), level.alias("level"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 60 AS paths, o_custkey % 7 AS texts, o_custkey % 3 AS images, (o_orderkey % 21) / 20.0::DOUBLE AS cover FROM orders)
SELECT o_orderkey, CASE WHEN images = 0 AND paths + texts = 0 THEN 'empty' WHEN cover >= 0.8 THEN 'raster' WHEN images > 0 AND cover >= 0.1 THEN 'mixed' WHEN paths + texts >= 8 THEN 'vector' ELSE 'empty' END AS content FROM o""")
def page_contents(spark, sf_dir) -> DataFrame:
    """What pages are made of, the share that images cover first: a scan stays one with a title block drawn on it."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select("o_orderkey", files.page_content(k % 60, F.col("o_custkey") % 7, F.col("o_custkey") % 3, (k % 21) / F.lit(20.0), scan=0.8, plain=0.1, least=8).alias("content"))


@query("""WITH o AS (SELECT p_partkey, p_size % 3 AS paths, p_size % 4 AS texts, p_size % 2 AS images, p_partkey % 10 / 10.0 AS cover FROM part)
SELECT p_partkey, CASE WHEN paths + texts = 0 AND images = 0 THEN 'empty' WHEN images > 0 AND cover >= 0.5 THEN CASE WHEN paths + texts > 0 THEN 'mixed' ELSE 'raster' END WHEN paths + texts > 0 THEN 'vector' ELSE 'raster' END AS content FROM o""")
def page_classes(spark, sf_dir) -> DataFrame:
    """Classes of pages by objects first; page_contents has coverage first."""
    p, n = table(spark, sf_dir, "part"), F.col("p_size")
    return p.select("p_partkey", files.page_class(n % 3, n % 4, n % 2, F.col("p_partkey") % 10 / 10).alias("content"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'zip' WHEN 3 THEN 'png' WHEN 4 THEN 'csv' ELSE 'unknown' END AS kind FROM part""")
def file_kinds(spark, sf_dir) -> DataFrame:
    """Kinds by first bytes, with the name as a tie-break."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    heads = [b"%PDF-1.7", b"PK\x03\x04", b"PK\x03\x04", b"\x89PNG\r\n", b"a,b\n", b"\x00\x01"]
    content = F.element_at(F.array(*[F.lit(bytearray(h)) for h in heads]), (k % 6).cast("int") + 1)
    return p.select("p_partkey", files.file_kind(content, wording(k, ("a", k, ".txt"), ("b", k, ".XLSX"), ("c", k), ("d", k, ".pdf"), ("e", k, ".csv"), ("f", k, ".bin"))).alias("kind"))


@query("""SELECT p_partkey, substring(sha256('{"p_name":"' || p_name || '","p_size":' || p_size || ',"none":null}'), 1, 24) AS digest FROM part""")
def inputs_digests(spark, sf_dir) -> DataFrame:
    """The digest of what an item was computed from; nulls count, row ids don't."""
    p = table(spark, sf_dir, "part").withColumn("none", F.lit(None).cast("string"))
    return p.select("p_partkey", versions.digest("p_name", "p_size", "none").alias("digest"))


@query("""SELECT s_suppkey AS sheet, unnest(['number', 'revision', 'scale']) AS field, unnest([s_name, 'P' || s_nationkey, '1:' || (50 + s_nationkey)]) AS value FROM supplier""")
def title_blocks(spark, sf_dir) -> DataFrame:
    """Values beside or below the labels of title blocks."""
    s = table(spark, sf_dir, "supplier")
    at = lambda t, x, y: F.struct(t.alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    n = F.col("s_nationkey")
    spans = F.array(
        at(F.lit("DRAWING NO."), 10.0, 100.0), at(F.col("s_name"), 40.0, 101.0), at(F.lit("Rev"), 10.0, 120.0), at(F.concat(F.lit("P"), n.cast("string")), 11.0, 130.0),
        at(F.lit("SCALE"), 100.0, 120.0), at(F.concat(F.lit("1:"), (50 + n).cast("string")), 125.0, 120.5), at(F.lit("General notes"), 300.0, 300.0),
    )
    rows = s.select(F.col("s_suppkey").alias("sheet"), F.explode(spans).alias("s")).select("sheet", "s.*")
    return layout_text.labelled_values(rows, "sheet", {"number": r"drawing no", "revision": r"^rev\b", "scale": r"^scale\b"})


@query("""SELECT s_nationkey AS sheet, s_suppkey AS a, s_suppkey AS b, 3.0::DOUBLE AS distance FROM supplier""")
def symbol_tags(spark, sf_dir) -> DataFrame:
    """Tags and the symbols that they belong to, one to one."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("sheet"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 10.0).alias("x"), F.lit(5.0).alias("y"))
    spans = s.select("sheet", "id", F.concat(F.lit("FHR-"), F.col("id").cast("string")).alias("text"), F.col("x"), F.lit(8.0).alias("y"))
    notes = s.select("sheet", (F.col("id") + 1_000_000).alias("id"), F.lit("see note").alias("text"), "x", "y")
    return layout_text.tagged(s, spans.union(notes), "sheet", r"^FHR-\d+$", 9.0)


@query("""SELECT c_custkey, 'Q-' || c_custkey AS reference, DATE '2024-03-05' AS day, CAST(10 + c_custkey % 50 AS INTEGER) AS validity_days, CASE WHEN c_custkey % 2 = 0 THEN 'SGD' ELSE 'USD' END AS currency, 'EX WORKS' AS terms, ['painting', c_name] AS exclusions FROM customer""")
def quotations_read(spark, sf_dir) -> DataFrame:
    """Fields and exclusions of quotations, from their lines of cells."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    line = lambda *cells: F.array(*[F.lit(x) if isinstance(x, str) else x for x in cells])
    lines = F.array(
        line("Acme Pumps"), line("Quotation No", F.concat(F.lit("Q-"), k.cast("string"))), line("Date: 5 Mar 2024"), line("Validity", F.concat((k % 50 + 10).cast("string"), F.lit(" days"))),
        line("Currency", F.when(k % 2 == 0, "S$ 1").otherwise("USD")), line("Delivery terms", "ex works"), line("Exclusions"), line("painting"), line(F.col("c_name")), line("Remarks:"), line("none"),
    )
    rows = c.select("c_custkey", F.posexplode(lines).alias("o", "cells"))
    return layout_text.quotation_fields(rows, "c_custkey", "o", "cells").withColumnRenamed("date", "day")


@query()
def review_draws(spark, sf_dir) -> DataFrame:
    """A repeatable sample of each review lot: three suppliers of a nation."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_name").alias("item"))
    return metrics.seeded_draws(s, "s_nationkey", "item", 3)


def clauses(spark, sf_dir) -> DataFrame:
    """A specification clause for each part, with its size in it."""
    n = F.col("p_size") + 50
    said = wording(
        F.col("p_partkey"), ("Pipes up to DN ", n, " shall be galvanised with screwed joints. Pipes of DN ", n + 1, " and above shall be black steel, grooved."), "Buried pipework shall be CPVC or equivalent.",
        ("Hangers of black steel pipe shall stand every ", n + 1000, " mm. Pipework shall be tested at ", n, " bar for 24 hours; Spare heads of 5% shall be handed over as required."),
        ("The system shall be guaranteed for ", n, " months. The contractor shall submit 3 copies of all drawings."), (F.col("p_name"), " to the satisfaction of the engineer."), "Testing in the basement is by others.",
    )
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("text"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, (p_size + 50)::INTEGER AS n FROM part)
SELECT p_partkey, 0 AS n, unnest(['material', 'joining']) AS attribute, unnest(['galvanised steel', 'threaded']) AS value, NULL::INTEGER AS dn_min, n AS dn_max, NULL::VARCHAR AS place FROM p WHERE k = 0
UNION ALL SELECT p_partkey, 1, unnest(['material', 'joining']), unnest(['black steel', 'grooved']), n + 1, NULL, NULL FROM p WHERE k = 0
UNION ALL SELECT p_partkey, 0, 'material', 'cpvc', NULL, NULL, 'below ground' FROM p WHERE k = 1
UNION ALL SELECT p_partkey, 0, 'hanger spacing', CAST(n + 1000 AS VARCHAR), NULL, NULL, NULL FROM p WHERE k = 2""")
def clause_attributes(spark, sf_dir) -> DataFrame:
    """Attributes that clauses state, with their range of sizes and their place (see clauses)."""
    return documents.attributes(clauses(spark, sf_dir), "p_partkey", "text")


@query("""SELECT p_partkey FROM part WHERE p_partkey % 6 IN (4, 5)""")
def clauses_not_read(spark, sf_dir) -> DataFrame:
    """Clauses that neither state an attribute nor put a duty with a figure."""
    c = clauses(spark, sf_dir)
    read = documents.attributes(c, "p_partkey", "text").select("p_partkey").union(documents.obligations(c, "p_partkey", "text").filter("figure IS NOT NULL").select("p_partkey"))
    return c.join(read, "p_partkey", "left_anti").select("p_partkey")


@query("""WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, (p_size + 50)::DOUBLE AS n FROM part)
SELECT p_partkey, unnest([1, 1, 2])::INTEGER AS n, unnest(['testing', 'testing', 'spares']) AS category, unnest(['bar', 'hours', 'percent']) AS unit, unnest([n, 24.0, 5.0]) AS figure FROM p WHERE k = 2
UNION ALL SELECT p_partkey, unnest([0, 1])::INTEGER, unnest(['warranty', 'submittals']), unnest(['months', 'copies']), unnest([n, 3.0]) FROM p WHERE k = 3
UNION ALL SELECT p_partkey, 0, 'testing', NULL, NULL FROM p WHERE k = 5""")
def clause_obligations(spark, sf_dir) -> DataFrame:
    """Duties that clauses put, with their figures (see clauses)."""
    return documents.obligations(clauses(spark, sf_dir), "p_partkey", "text")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 'or equivalent' WHEN 2 THEN 'as required' ELSE 'to the satisfaction of' END AS phrase FROM part WHERE p_partkey % 6 IN (1, 2, 4)""")
def vague_clauses(spark, sf_dir) -> DataFrame:
    """Wordings of clauses that leave open what has to be done (see clauses)."""
    return documents.vague_phrases(clauses(spark, sf_dir), "p_partkey", "text")


@query("""WITH s AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey = 7 THEN 'hydrant' WHEN n_nationkey % 5 IN (0, 4) THEN 'sprinkler' WHEN n_nationkey % 5 = 1 THEN 'hydrant' END AS system FROM nation)
SELECT CAST(k AS VARCHAR) AS number, system FROM s UNION ALL SELECT c_nationkey || '.' || c_custkey, system FROM customer JOIN s ON k = c_nationkey""")
def section_systems(spark, sf_dir) -> DataFrame:
    """The system of each clause, by its section's heading or a person's answer."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    heads = n.select(k.cast("string").alias("number"), wording(k, "Sprinkler installation", "Fire hydrants", "Electrical works", "General", "Plumbing for sprinklers").alias("heading"))
    rest = table(spark, sf_dir, "customer").select(F.concat_ws(".", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")).alias("number"), F.col("c_name").alias("heading"))
    decided = n.filter("n_nationkey = 7").select(k.cast("string").alias("section"), F.lit("hydrant").alias("system"))
    return documents.section_systems(heads.unionByName(rest), decided, "number", "heading")
