"""Corpus queries on documents, conversations, pages and the benchmark: dedup, splits, scans, pairs, windows, records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from decisa.functions import text
from decisa.operators import corpus, joins, panel as books, validate
from decisa.plans.base import query, rounded, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query("SELECT sha256(text) AS key, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(spark, sf_dir):
    return corpus.first_ids(docs(spark, sf_dir), F.sha2("text", 256), "doc_id")


@query(rf"SELECT sha256({NORM}) AS key, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1")
def normalized_dedup(spark, sf_dir):
    return corpus.first_ids(docs(spark, sf_dir), F.sha2(text.normalize(F.col("text")), 256), "doc_id")


@query(rf"""WITH t AS (SELECT conv_id, turn, sha256({NORM}) AS h FROM conversations) SELECT conv_id, sha256(string_agg(h, chr(31) ORDER BY turn)) AS state FROM t GROUP BY conv_id""")
def conversation_state_hash(spark, sf_dir):
    t = turns(spark, sf_dir).select("conv_id", F.struct("turn", F.sha2(text.normalize(F.col("text")), 256).alias("h")).alias("t"))
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return g.select("conv_id", F.sha2(F.array_join(F.transform("t", lambda x: x["h"]), "\x1f"), 256).alias("state"))


@query(r"""SELECT md5(trim(regexp_replace(lower(regexp_replace(text, '\d', '#', 'g')), '\s+', ' ', 'g'))) AS key, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1""")
def boilerplate_turns(spark, sf_dir):
    t = turns(spark, sf_dir).groupBy(F.md5(text.boilerplate_key(F.col("text"))).alias("key")).agg(F.count("*").alias("n"))
    return t.filter("n > 1")


@query("""SELECT doc_id, CASE WHEN b < 10 THEN 'eval' WHEN b < 20 THEN 'dev' ELSE 'train' END AS split, b AS bucket FROM (SELECT doc_id, CAST(('0x' || substring(sha256('v1:' || source), 1, 8)) AS BIGINT) % 100 AS b FROM documents)""")
def hash_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.hash_split(F.col("source"), "v1").alias("split"), text.hash_bucket(F.col("source"), "v1", 100).alias("bucket"))


@query("""WITH s AS (SELECT sha256(text) AS key, CASE WHEN CAST(('0x' || substring(sha256('v1:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 10 THEN 'eval' ELSE 'train' END AS split, lang FROM documents)
SELECT key, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits, count(*) AS rows, count(DISTINCT lang) > 1 AS conflict FROM s GROUP BY key HAVING count(DISTINCT split) > 1""")
def cross_split_leakage(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.sha2("text", 256).alias("key"), F.when(text.hash_bucket(F.col("doc_id").cast("string"), "v1", 100) < 10, "eval").otherwise("train").alias("split"), "lang")
    return corpus.leakage_audit(d, "key", "split", "lang").withColumn("splits", F.array_join("splits", ","))


@query(r"""SELECT lang AS split, sha256(regexp_replace(text, '\d+', '<N>', 'g')) AS state, count(*) AS rows, count(DISTINCT source) AS labels FROM documents GROUP BY 1, 2 HAVING count(DISTINCT source) > 1""")
def label_consistency(spark, sf_dir):
    return corpus.label_conflicts(docs(spark, sf_dir), "lang", F.col("text"), "source").withColumnRenamed("lang", "split")


@query("""WITH e AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY sha256(source), source) - 1 AS k, count(*) OVER () AS n FROM e)
SELECT source, CASE WHEN k < (n % 3) * (n // 3 + 1) THEN k // (n // 3 + 1) ELSE n % 3 + (k - (n % 3) * (n // 3 + 1)) // greatest(1, n // 3) END AS part FROM r""")
def entity_thirds(spark, sf_dir):
    return corpus.entity_cut(docs(spark, sf_dir), "source")


def _secret_sql() -> str:
    arms = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in text.SECRETS)
    return f"SELECT doc_id, CASE {arms} END AS secret FROM documents"


@query(_secret_sql())
def secret_scan(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.secret_kind(F.col("text")).alias("secret"))


@query(f"WITH s AS ({_secret_sql()}), d AS (SELECT source, bool_or(secret IS NOT NULL) AS bad FROM s JOIN documents USING (doc_id) GROUP BY source) SELECT d.source, bad, count(*) AS docs FROM documents JOIN d USING (source) GROUP BY 1, 2".replace("d.source", "source"))
def group_secret_drop(spark, sf_dir):
    """A hit anywhere drops the whole group."""
    d = docs(spark, sf_dir).select("source", text.secret_kind(F.col("text")).isNotNull().alias("hit"))
    return d.groupBy("source").agg(F.bool_or("hit").alias("bad"), F.count("*").alias("docs"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, 'https?://[^\s<>"'')]+')) AS urls, len(regexp_extract_all(html, '\b\d+(?:\.\d+)?\b')) AS numbers, len(regexp_extract_all(html, '\b\d+(?:\.\d+)?%')) AS percents FROM pages""")
def regex_extraction(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", *[F.size(text.extract(h, k)).alias(n) for k, n in (("url", "urls"), ("number", "numbers"), ("percent", "percents"))])


@query(r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark)
SELECT item_id, len(list_distinct(list_transform(range(1, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i:i+5], ' ')))) AS shingles FROM w""")
def word_shingles(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(text.shingles(F.col("text"))).alias("shingles"))


#: Distinct hashes of benchmark shingles that are broadcast at most, 16 bytes each.
BROADCAST_HASHES = 1_000_000
SHINGLES = r"""s(id, s) AS (SELECT id, unnest(list_distinct(list_transform(range(1, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i:i+5], ' ')))) FROM (SELECT {id} AS id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM {table}))"""


@query("WITH " + SHINGLES.format(id="doc_id", table="documents").replace("s(id, s)", "d(id, s)") + ", " + SHINGLES.format(id="item_id", table="benchmark").replace("s(id, s)", "b(id, s)") + """, n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared, round(count(*) / any_value(n.n)::DOUBLE, 6) AS contained FROM d JOIN b USING (s) JOIN n ON n.id = b.id GROUP BY d.id, b.id""")
def shingle_containment(spark, sf_dir):
    """Documents against benchmark items by shared six-word shingles. The benchmark's shingles are broadcast, as hashes
    and only up to a counted number, so a document's others aren't shuffled."""
    d = docs(spark, sf_dir).select("doc_id", F.explode(text.shingles(F.col("text"))).alias("s"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.shingles(F.col("text"))).alias("s"))
    hashes = b.select(F.xxhash64("s").alias("h")).distinct()
    if hashes.count() <= BROADCAST_HASHES:
        d = d.withColumn("h", F.xxhash64("s")).join(F.broadcast(hashes), "h", "leftsemi").drop("h")
    n = b.groupBy("item_id").agg(F.count("*").alias("n"))
    out = d.join(b, "s").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared")).join(n, "item_id")
    return rounded(out.select("doc_id", "item_id", "shared", (F.col("shared") / F.col("n")).alias("contained")))


@query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 10 = 0 AND sha256(e.text) = sha256(documents.text)) AND doc_id % 10 <> 0")
def frozen_decontamination(spark, sf_dir):
    """Rows of the rest that share no text with a frozen tenth."""
    d = docs(spark, sf_dir).withColumn("h", F.sha2("text", 256))
    return corpus.decontaminate(d.filter("doc_id % 10 <> 0"), d.filter("doc_id % 10 = 0"), ["h"]).select("doc_id", "source")


@query("""WITH h AS (SELECT doc_id, sha256(text) AS h, doc_id % 2 AS side FROM documents), l AS (SELECT h, count(DISTINCT doc_id) AS n FROM h WHERE side = 0 GROUP BY h), r AS (SELECT h, count(DISTINCT doc_id) AS n FROM h WHERE side = 1 GROUP BY h)
SELECT count(*) AS shared_keys, CAST(coalesce(sum(l.n), 0) AS BIGINT) AS left_records, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS right_records FROM l JOIN r USING (h)""")
def cohort_intersection(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"))
    return joins.cohort_intersection(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), "h", "doc_id")


@query("""WITH RECURSIVE d AS (SELECT doc_id, sha256(text) AS a, concat_ws(':', lang, source, n_chars) AS b, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
r(k, doc_id, kept, sa, sb) AS (SELECT 0::BIGINT, NULL::BIGINT, false, []::VARCHAR[], []::VARCHAR[] UNION ALL
  SELECT k, doc_id, fresh, CASE WHEN fresh AND a IS NOT NULL THEN list_append(sa, a) ELSE sa END, CASE WHEN fresh THEN list_append(sb, b) ELSE sb END FROM (SELECT d.*, r.sa, r.sb, coalesce(NOT list_contains(r.sa, d.a), true) AND NOT list_contains(r.sb, d.b) AS fresh FROM r JOIN d ON d.k = r.k + 1))
SELECT doc_id FROM r WHERE kept""")
def either_key_dedup(spark, sf_dir):
    """A row goes when its text or its (language, source, length) was seen on a kept row before."""
    d = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("a"), F.concat_ws(":", "lang", "source", F.col("n_chars").cast("string")).alias("b"))
    return corpus.keep_first_of_either(d, "a", "b", "doc_id").select("doc_id")


@query("""WITH RECURSIVE e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id), r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x AS node, least(x, min(y)) AS component FROM r GROUP BY x""")
def copy_components(spark, sf_dir):
    """Connected components of equal texts: edges lead from each copy to the first of its text."""
    d = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return joins.components(d.join(first, "h").select("doc_id", "first"), "doc_id", "first")


@query("""WITH l AS (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, turn, role, coalesce(role = 'assistant' OR (role = 'user' AND turn < last), false) AS eligible FROM l""")
def eligible_turns(spark, sf_dir):
    return corpus.eligible(turns(spark, sf_dir), ["conv_id"], "turn", "role").select("conv_id", "turn", "role", F.coalesce("eligible", F.lit(False)).alias("eligible"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) > 1 AS dropped FROM conversations")
def safe_turn_dedup(spark, sf_dir):
    return corpus.verified_repeats(turns(spark, sf_dir), ["conv_id"], ["role", "text"], "turn").select("conv_id", "turn", "dropped")


@query("""WITH u AS (SELECT conv_id, turn, role, (role = 'user')::INT AS o FROM conversations WHERE role IN ('user', 'assistant')), b AS (SELECT *, sum(CASE WHEN o = 1 THEN 1 ELSE -1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS bal FROM u),
m AS (SELECT *, least(0, min(bal) OVER (PARTITION BY conv_id ORDER BY turn)) AS low FROM b), s AS (SELECT *, o = 0 AND low < coalesce(lag(low) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS skip FROM m),
k AS (SELECT *, CASE WHEN o = 1 THEN sum(o) OVER w WHEN NOT skip THEN sum((o = 0 AND NOT skip)::INT) OVER w END AS k FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT a.conv_id, a.turn AS open_pos, c.turn AS close_pos FROM k a JOIN k c ON a.conv_id = c.conv_id AND a.k = c.k AND a.o = 1 AND c.o = 0 AND NOT c.skip""")
def fifo_pairs(spark, sf_dir):
    """Each user turn with the assistant turn that answers it, first in first out."""
    return corpus.fifo_pairs(turns(spark, sf_dir), ["conv_id"], "turn", "role", "user", "assistant")


@query("""WITH c AS (SELECT *, length(text) AS cost, role = 'system' AS protected FROM conversations), f AS (SELECT *, sum(CASE WHEN protected THEN cost ELSE 0 END) OVER (PARTITION BY conv_id) AS floor, sum(CASE WHEN protected THEN 0 ELSE cost END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS run FROM c)
SELECT conv_id, turn, protected OR run + floor <= 1500 AS kept, floor > 1500 AS overflow FROM f""")
def drop_oldest_turns(spark, sf_dir):
    t = turns(spark, sf_dir).withColumns({"cost": F.length("text"), "protected": F.col("role") == "system"})
    return corpus.drop_oldest(t, ["conv_id"], "turn", "cost", "protected", 1500).select("conv_id", "turn", "kept", "overflow")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS cost, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn = last THEN -1 ELSE last - turn END, turn) AS k FROM t),
r(conv_id, k, used, kept) AS (SELECT conv_id, k, cost, [turn] FROM o WHERE k = 1 UNION ALL SELECT o.conv_id, o.k, CASE WHEN r.used + o.cost <= 1500 THEN r.used + o.cost ELSE r.used END, CASE WHEN r.used + o.cost <= 1500 THEN list_append(r.kept, o.turn) ELSE r.kept END FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1)
SELECT conv_id, CAST(arg_max(used, k) AS BIGINT) AS used, array_to_string(list_sort(arg_max(kept, k)), ',') AS kept FROM r GROUP BY conv_id""")
def nearest_first_window(spark, sf_dir):
    """Turns around each conversation's last one within a budget, nearest first, skipping what doesn't fit."""
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    t = turns(spark, sf_dir).withColumns({"cost": F.length("text"), "anchor": F.col("turn") == last})
    out = corpus.nearest_window(t, ["conv_id"], "turn", "cost", "anchor", 1500)
    return out.select("conv_id", "used", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


@query("""WITH d AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, lang, doc_id) AS n FROM d) SELECT doc_id, source, lang FROM n WHERE n <= 5""")
def round_robin_pick(spark, sf_dir):
    """Five documents of each source, one language in turn; the cap is the operator's feature."""
    return books.round_robin(docs(spark, sf_dir).select("doc_id", "source", "lang"), ["source"], "lang", ["doc_id"], 5)


@query("SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM documents) WHERE rank <= 3")
def hash_rank_cap(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "source", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return books.top_k(d, ["source"], ["h", "doc_id"], 3).select("doc_id", "source", "rank")


@query("""WITH l AS (SELECT d.source AS key, d.lang AS anchor, l.quality AS label FROM documents d JOIN labels l USING (doc_id)) SELECT key, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, count(DISTINCT anchor) AS anchors FROM l GROUP BY key HAVING count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label = 0) > 0 AND count(DISTINCT anchor) > 1""")
def contrast_pairs(spark, sf_dir):
    d = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("key"), F.col("lang").alias("anchor"), F.col("quality").alias("label"))
    return corpus.assign_pairs(d, "key", "anchor", "label")


@query(r"""WITH t AS (SELECT conv_id, unnest(list_distinct(regexp_split_to_array(lower(text), '\s+'))) AS term FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)), n AS (SELECT term, count(DISTINCT conv_id) AS df FROM t WHERE length(term) BETWEEN 8 AND 40 GROUP BY term HAVING count(DISTINCT conv_id) <= 3)
SELECT conv_id, count(*) AS rare FROM (SELECT DISTINCT conv_id, term FROM t JOIN n USING (term)) GROUP BY conv_id""")
def rare_identifiers(spark, sf_dir):
    t = turns(spark, sf_dir).select("conv_id", text.words(F.lower("text")).alias("terms"))
    return corpus.rare_terms(t, "conv_id", "terms").select("conv_id", "term").distinct().groupBy("conv_id").agg(F.count("*").alias("rare"))


@query(r"""SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words, length(trim(text)) <= 40 AND regexp_matches(trim(text), '(?i)^(ok(ay)?|thanks?|thank you|yes|yep|sure|go on|continue|next|great|done)\b') AS ack FROM conversations""")
def turn_classifiers(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", text.word_estimate(F.col("text")).alias("words"), text.acknowledges(F.col("text")).alias("ack"))


@query("SELECT conv_id, turn, length(CASE WHEN octet_length(encode(text)) <= 600 THEN text WHEN octet_length(encode(substring(text, 1, 2000))) <= 600 THEN substring(text, 1, 2000) WHEN octet_length(encode(substring(text, 1, 500))) <= 600 THEN substring(text, 1, 500) WHEN octet_length(encode(substring(text, 1, 120))) <= 600 THEN substring(text, 1, 120) ELSE '' END) AS chars FROM conversations")
def budget_ladder(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.length(text.fit_budget(F.col("text"), 600)).alias("chars"))


@query("SELECT doc_id, CASE WHEN length(text) < 40 THEN 0 ELSE len(list_distinct([substring(text, 1, 60), substring(text, greatest(1, length(text) // 2 - 30 + 1), 60), substring(text, greatest(1, length(text) - 60 + 1), 60)])) END AS chunks FROM documents")
def positional_signatures(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(text.signatures(F.col("text"))).alias("chunks"))


@query("SELECT doc_id, CASE WHEN n_chars >= 5000 THEN 'xl' WHEN n_chars >= 1500 THEN 'l' WHEN n_chars >= 300 THEN 'm' ELSE 's' END AS band FROM documents")
def length_bands(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.band(F.col("n_chars"), [(5000, "xl"), (1500, "l"), (300, "m")], "s").alias("band"))


@query("SELECT doc_id, CAST(('0x' || substring(sha256('draw|' || doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents")
def uniform_draws(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.uniform("draw", F.col("doc_id")).alias("u"))


@query("""WITH a AS (SELECT doc_id, 'label' || quality AS source, 0 AS p FROM labels), b AS (SELECT doc_id, source, 1 AS p FROM documents), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM u) WHERE k = 1""")
def precedence_merge(spark, sf_dir):
    """Labels go before the documents' own sources."""
    d = docs(spark, sf_dir).select("doc_id", "source")
    return joins.precedence_merge([table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("label"), "quality").alias("source")), d], ["doc_id"])


@query("""WITH o AS (SELECT doc_id, 'documents' AS origin FROM documents UNION ALL SELECT doc_id, 'labels' FROM labels UNION ALL SELECT item_id, 'benchmark' FROM benchmark) SELECT origin, count(*) AS n, count(DISTINCT doc_id) AS ids FROM o GROUP BY origin""")
def origin_accounting(spark, sf_dir):
    of = lambda name, key="doc_id": table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), F.lit(name).alias("origin"))
    u = of("documents").unionByName(of("labels")).unionByName(of("benchmark", "item_id"))
    return u.groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))


@query("SELECT 'both' AS side, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'left', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def set_operations(spark, sf_dir):
    a, b = docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    side = lambda d, n: d.agg(F.lit(n).alias("side"), F.count("*").alias("n"))
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "left"))


@query(r"""WITH n AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) >= 10) AS w FROM conversations), u AS (SELECT DISTINCT conv_id, turn, unnest(w) AS needle FROM n),
h AS (SELECT u.conv_id, u.turn, u.needle, s.turn AS echo_pos, row_number() OVER (PARTITION BY u.conv_id, u.turn ORDER BY length(u.needle) DESC, s.turn, u.needle) AS k FROM u JOIN conversations s ON s.conv_id = u.conv_id AND s.turn > u.turn AND contains(s.text, u.needle))
SELECT conv_id, turn, echo_pos, needle, CAST(length(needle) AS INT) AS strength FROM h WHERE k = 1""")
def echo_join(spark, sf_dir):
    """For each turn the first later turn that repeats one of its long words, longest first."""
    t = turns(spark, sf_dir)
    u = t.select("conv_id", "turn", F.explode(F.array_distinct(F.filter(text.words(F.col("text")), lambda w: F.length(w) >= 10))).alias("needle")).withColumn("strength", F.length("needle"))
    return joins.first_echo(u, t, ["conv_id"], "turn")


@query(r"""WITH p AS (SELECT regexp_extract(url, '^[^:]+://[^/]+(/[^?#]*)', 1) AS path, count(*) AS pages, min(page_id) AS page_id FROM pages WHERE url IS NOT NULL GROUP BY 1)
SELECT a.path, b.path AS suffix, a.page_id, b.page_id AS suffix_page, a.pages, b.pages AS suffix_pages FROM p a JOIN p b ON a.path <> b.path AND ltrim(b.path, '/') <> '' AND ends_with(a.path, '/' || ltrim(b.path, '/'))""")
def path_suffix_join(spark, sf_dir):
    """Links between distinct paths, one ending in the other at a slash, each with its first page and number of pages;
    the pages of one path are not paired."""
    p = table(spark, sf_dir, "pages").filter("url is not null").select("page_id", F.regexp_extract("url", r"^[^:]+://[^/]+(/[^?#]*)", 1).alias("path"))
    return joins.path_links(p.groupBy("path").agg(F.min("page_id").alias("page_id"), F.count("*").alias("pages")), "path")


@query("""WITH k AS (SELECT conv_id, turn, role, conv_id * 1000 + turn AS key FROM conversations), o AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY sha256('v1|' || key), key) AS k, count(*) OVER (PARTITION BY role) AS n FROM k)
SELECT a.conv_id, a.turn, a.role, arg_min(b.key, (b.k - a.k + a.n) % a.n) AS donor FROM o a LEFT JOIN o b ON a.role = b.role AND a.conv_id <> b.conv_id GROUP BY 1, 2, 3""")
def donor_turns(spark, sf_dir):
    """Each turn with a donor of its role from another conversation."""
    t = turns(spark, sf_dir).withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    return joins.donor_join(t, "role", "conv_id", "key", "v1").select("conv_id", "turn", "role", "donor")


@query("""WITH RECURSIVE r(conv_id, turn) AS (SELECT conv_id, max(turn) FROM conversations GROUP BY conv_id UNION SELECT r.conv_id, c.turn FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn - 2) SELECT conv_id, turn FROM r""")
def dependency_closure(spark, sf_dir):
    """Turns that the last one depends on, where each depends on the turn two before it."""
    t = turns(spark, sf_dir).select(F.col("conv_id").alias("group"), "turn")
    edges = t.select("group", F.col("turn").alias("src"), (F.col("turn") - 2).alias("dst")).join(t.select("group", F.col("turn").alias("dst")), ["group", "dst"])
    seeds = t.groupBy("group").agg(F.max("turn").alias("node"))
    return joins.closure(edges, seeds).select(F.col("group").alias("conv_id"), F.col("node").alias("turn"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 100 THEN 'short' WHEN lang <> 'en' THEN 'language' WHEN source = 'src0' THEN 'source' ELSE 'kept' END AS reason FROM documents) GROUP BY reason""")
def skip_reasons(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("reason", validate.first_reason([("short", F.col("n_chars") >= 100), ("language", F.col("lang") == "en"), ("source", F.col("source") != "src0")]))
    return validate.reason_counts(d, "reason")


@query("""WITH e AS (SELECT event_id AS id, epoch_us(ts) AS us, value, CAST(event_id % 5 AS BIGINT) AS lag FROM events) SELECT reason, count(*) AS n FROM (SELECT CASE WHEN value > 95 THEN 'universe_late' WHEN lag = 4 THEN 'available_after_decision' WHEN lag = 3 THEN 'label_ends_early' ELSE 'kept' END AS reason FROM e) GROUP BY reason""")
def pit_validation(spark, sf_dir):
    """Events as point-in-time records, some made late on purpose; counts by first failing rule."""
    us, lag = F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id") % 5
    e = table(spark, sf_dir, "events").select(
        (us * 1000).alias("decision_ns"), (us * 1000 + F.when(F.col("value") > 95, 1).otherwise(0)).alias("universe_available_ns"),
        F.create_map(F.lit("v"), F.struct(F.col("value").alias("value"), (us * 1000 - 5).alias("event_ns"), (us * 1000 + F.when(lag == 4, 7).otherwise(0)).alias("available_ns"), (us * 1000 - 9).alias("fit_cutoff_ns"))).alias("features"),
        F.struct((us * 1000 + F.when(lag == 3, 0).otherwise(10)).alias("end_ns"), (us * 1000 + 20).alias("available_ns")).alias("label"),
    )
    return validate.reason_counts(e.withColumn("reason", validate.pit_reason()), "reason")


@query("""SELECT 'repeated_id' AS fault, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'repeated_snapshot', CAST(coalesce(sum(k), 0) AS BIGINT) FROM (SELECT count(*) AS k FROM events GROUP BY user_id, event_type, CAST(ts AS DATE) HAVING count(*) > 1)""")
def cohort_faults(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return validate.cohort_faults(e, "event_id", ["user_id", "event_type", "day"])


@query("""WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' END AS kind, turn // 2 AS call FROM conversations WHERE role <> 'system'),
g AS (SELECT conv_id, call, count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'result') AS results, min(turn) FILTER (kind = 'call') AS c, min(turn) FILTER (kind = 'result') AS r FROM c GROUP BY 1, 2)
SELECT conv_id, min(CASE WHEN calls > 1 THEN 'repeated_call' WHEN results > 0 AND (c IS NULL OR r < c) THEN 'orphan_result' WHEN results > 1 THEN 'repeated_result' WHEN results = 0 THEN 'pending_call' END) AS reason FROM g GROUP BY conv_id""")
def tool_link_check(spark, sf_dir):
    t = turns(spark, sf_dir).filter("role <> 'system'").withColumns({"kind": F.when(F.col("role") == "user", "call").otherwise("result"), "call": F.floor(F.col("turn") / 2)})
    return validate.tool_link_reason(t, ["conv_id"], "turn", "kind", "call")


@query("SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'structure' WHEN length(text) > 1000 THEN 'flagged' WHEN role <> 'assistant' THEN 'not_eligible' ELSE 'droppable' END AS policy FROM conversations")
def protection_policy(spark, sf_dir):
    t = turns(spark, sf_dir).withColumns({"s": F.col("role") == "system", "f": F.length("text") > 1000, "e": F.col("role") == "assistant"})
    return validate.protection(t, "s", "f", "e").select("conv_id", "turn", "policy")


@query("SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source, lang")
def keyed_counts(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
