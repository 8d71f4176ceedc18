"""Readers, data-quality checks, scans, evidence graph and provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import distributed as D
from ..operators import linkage as L
from ..operators import rules as R
from ..sources import adapters as A
from ..sources import formats as Fm
from ..sources.routes import routes
from ..sources.shared import shared_folder, written
from ..sources.tables import read
from .registry import TRACE, q6, query, r6, with_
from .rule_queries import ROUTES


def scratch(spark, name, sf):
    import hashlib
    return f"{shared_folder(spark)}/chronaxis/{spark.sparkContext.applicationId}/files/{name}-{hashlib.sha256(sf.encode()).hexdigest()[:8]}"


# ---- file sources --------------------------------------------------------------------

MAN = """man AS (SELECT p_partkey AS video_id, CASE p_partkey % 5 WHEN 0 THEN 'MVMA' WHEN 1 THEN 'LVLA' WHEN 2 THEN 'LVHA' WHEN 3 THEN 'HVHA' ELSE 'XX' END AS target_code, p_type AS target_label, trim(p_name) AS title,
 CAST(p_size * 3 + 1 AS INTEGER) AS reported, CAST(CASE WHEN p_partkey % 17 = 0 THEN p_size * 3 + 9 ELSE p_size * 3 END AS INTEGER) AS annotation, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN substr(sha256(p_name), 1, 60) ELSE sha256(p_name) END AS hash FROM part)"""


def manifest(spark, sf):
    """A manifest CSV written from ``part`` and read back through the reader."""
    p = read(spark, sf, "part")
    code = F.element_at(F.array(*map(F.lit, ("MVMA", "LVLA", "LVHA", "HVHA", "XX"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    h = F.sha2("p_name", 256)
    out = p.select(
        F.col("p_partkey").alias("video_id"), code.alias("target_code"), F.col("p_type").alias("target_label"), F.lit("part").alias("source_dataset"),
        F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("title"), (F.col("p_size") * 3 + 1).alias("reported_duration_seconds"),
        F.when(F.col("p_partkey") % 17 == 0, F.col("p_size") * 3 + 9).otherwise(F.col("p_size") * 3).alias("annotation_seconds"),
        F.concat(F.lit("clip/"), F.col("p_partkey").cast("string")).alias("local_filename"), F.lit("ref").alias("source_reference"), F.lit("").alias("source_excerpt"),
        F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, F.substring(h, 1, 60)).otherwise(F.upper(h)).alias("expected_sha256"), F.lit("open").alias("access_status"))
    path = scratch(spark, "manifest", sf)
    out.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return Fm.read_manifest(spark, path)


@query("src2_item_manifest", with_(MAN) + "SELECT CAST(video_id AS INTEGER) AS video_id, target_code, target_label, title, reported AS reported_duration_seconds, annotation AS annotation_seconds, hash AS expected_sha256 FROM man")
def _(spark, sf):
    return manifest(spark, sf).select("video_id", "target_code", "target_label", "title", "reported_duration_seconds", "annotation_seconds", "expected_sha256")


@query("dq5_manifest_rules", with_(MAN) + """SELECT CAST(video_id AS INTEGER) AS video_id, unnest(list_filter([CASE WHEN target_code NOT IN ('MVMA','LVLA','LVHA','HVHA','HVLA') THEN 'unknown target code' END, CASE WHEN annotation > reported + 2 THEN 'annotation longer than clip' END,
 CASE WHEN hash <> '' AND NOT regexp_matches(hash, '^[0-9a-f]{64}$') THEN 'hash form' END, CASE WHEN reported <= 0 OR annotation <= 0 THEN 'duration not positive' END], lambda x: x IS NOT NULL)) AS problem FROM man""")
def _(spark, sf):
    m = manifest(spark, sf)
    checks = [F.when(~F.col("target_code").isin("MVMA", "LVLA", "LVHA", "HVHA", "HVLA"), "unknown target code"),
              F.when(F.col("annotation_seconds") > F.col("reported_duration_seconds") + 2, "annotation longer than clip"),
              F.when((F.col("expected_sha256") != "") & ~F.col("expected_sha256").rlike("^[0-9a-f]{64}$"), "hash form"),
              F.when((F.col("reported_duration_seconds") <= 0) | (F.col("annotation_seconds") <= 0), "duration not positive")]
    return m.select("video_id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


RATE = "SELECT subject, CASE video WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS video, CAST(1 + count(*) % 9 AS DOUBLE) AS valence, CAST(1 + (count(*) * 5) % 9 AS DOUBLE) AS arousal FROM trace GROUP BY 1, video"


@query("src3_wide_ratings", with_(TRACE) + f"SELECT 'test_' || subject AS subject, CAST(video AS INTEGER) AS video, {q6('1 + (valence - 1) * 31.75')} AS anchor_valence, {q6('1 + (arousal - 1) * 31.75')} AS anchor_arousal FROM ({RATE})")
def _(spark, sf):
    t = A.trace(spark, sf)
    k = F.when(F.col("video") == "click", 1).when(F.col("video") == "error", 2).when(F.col("video") == "purchase", 3).when(F.col("video") == "signup", 4).otherwise(5)
    n = t.groupBy("subject", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    at = lambda i, e: F.max(F.when(F.col("k") == i, e))
    wide = n.groupBy(F.concat(F.lit("test_"), F.col("subject").cast("string")).alias("sub_id")).agg(*[
        c for i in range(1, 6) for c in (at(i, 1 + F.col("n") % 9).alias(f"Video_{i}_Valence"), at(i, 1 + (F.col("n") * 5) % 9).alias(f"Video_{i}_Arousal"))])
    path = scratch(spark, "ratings", sf)
    wide.write.mode("overwrite").option("header", True).csv(path)
    r = Fm.read_wide_ratings(spark, path, 5).filter(F.col("valence").isNotNull())
    return r.select("subject", "video", r6(S.rating_to_label(F.col("valence")), "anchor_valence"), r6(S.rating_to_label(F.col("arousal")), "anchor_arousal"))


@query("src4_channel_masks", "SELECT 's' || s_suppkey AS subject, CAST(c AS INTEGER) AS channel, CASE WHEN (s_suppkey + c) % 3 = 0 THEN 0.0 ELSE CAST((s_suppkey + c) % 3 AS DOUBLE) / 2 END::DOUBLE AS w FROM supplier, (SELECT unnest(range(1, 52)) AS c)")
def _(spark, sf):
    s = read(spark, sf, "supplier")
    v = lambda c: F.when((F.col("s_suppkey") + c) % 3 != 0, ((F.col("s_suppkey") + c) % 3 / 2).cast("string"))
    path = scratch(spark, "masks", sf)
    s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("sub_id"), *[v(c).alias(f"ch-{c}") for c in range(1, 52)]).write.mode("overwrite").option("header", True).csv(path)
    return Fm.read_masks(spark, path, 51)


@query("src5_category_codes", """WITH l AS (SELECT p_partkey, 'codes: [' || (p_size % 5) || ', ' || (p_partkey % 7) || ', ' || (p_partkey % 5) || ']' AS line FROM part)
SELECT code, count(*) AS n FROM (SELECT CAST(unnest(regexp_extract_all(line, '\\b([0-4])\\b', 1)) AS INTEGER) AS code FROM l) GROUP BY code""")
def _(spark, sf):
    p = read(spark, sf, "part")
    k = F.col("p_partkey")
    line = F.concat(F.lit("codes: ["), (F.col("p_size") % 5).cast("string"), F.lit(", "), (k % 7).cast("string"), F.lit(", "), (k % 5).cast("string"), F.lit("]"))
    path = scratch(spark, "codes", sf)
    p.select(line.alias("value")).write.mode("overwrite").text(path)
    return Fm.read_code_lines(spark, path).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("src7_route_documents", "WITH " + ROUTES + " SELECT deployment_stage, user_control, count(*) AS routes FROM routes GROUP BY 1, 2")
def _(spark, sf):
    path = scratch(spark, "routes", sf)
    r = routes(spark, sf).select("id", "deployment_stage", "route_capability", "evidence")
    r.write.mode("overwrite").json(path)
    ev = ", ".join(f"{f.name}: STRING" for f in r.schema["evidence"].dataType.fields)
    d = Fm.read_documents(spark, path, f"id BIGINT, deployment_stage STRING, route_capability STRING, evidence STRUCT<{ev}>")
    return d.groupBy("deployment_stage", F.col("evidence.user_control").alias("user_control")).agg(F.count(F.lit(1)).alias("routes"))


@query("src9_union_of_columns", "SELECT 'nation' AS kind, n_nationkey AS id, n_name AS name, n_regionkey AS parent FROM nation UNION ALL SELECT 'customer', CAST(c_custkey AS INTEGER), c_name, NULL FROM customer")
def _(spark, sf):
    a = read(spark, sf, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    b = read(spark, sf, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("kind"), F.col("c_custkey").cast("int").alias("id"))
    return Fm.stack_tables(a, b)


@query("src11_result_bundle")
def _(spark, sf):
    """Row count and an order-free content digest per table of a result bundle."""
    t = A.trace(spark, sf)
    tables = {"durations": t.groupBy("video").agg((F.max("t") + 1).alias("d")), "lengths": A.trial_lengths(t), "folds": A.subject_folds(t)}
    parts = []
    for name, df in tables.items():
        row = F.xxhash64(F.concat_ws("|", *[F.col(c).cast("string") for c in sorted(df.columns)]))
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("|", F.bit_xor(row).cast("string"), F.sum(row % 1000003).cast("string")), 256).alias("digest")).select(F.lit(name).alias("name"), "rows", "digest"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("ag21_partition_digest", """WITH a AS (SELECT user_id // 64 AS b, sha256(string_agg(CAST(user_id AS VARCHAR), '|' ORDER BY user_id)) AS h FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1),
c AS (SELECT b // 4096 AS b2, count(*) AS n, sha256(string_agg(h, '|' ORDER BY b)) AS h FROM a GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS blocks, sha256(string_agg(h, '|' ORDER BY b2)) AS digest FROM c""")
def _(spark, sf):
    # a tree of digests: 64 ids per leaf, 4096 leaves per branch, one branch digest per 262,144 ids at the top
    ids = read(spark, sf, "events").select("user_id").distinct().withColumn("b", F.floor(F.col("user_id") / 64))
    joined = lambda order, text: F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).cast("string").alias("x"))))["x"]), 256)
    leaf = ids.groupBy("b").agg(joined("user_id", "user_id").alias("h"))
    branch = leaf.groupBy(F.floor(F.col("b") / 4096).alias("b2")).agg(F.count(F.lit(1)).alias("n"), joined("b", "h").alias("h"))
    return branch.agg(F.sum("n").alias("blocks"), joined("b2", "h").alias("digest"))


@query("flt14_portable_paths", "SELECT page_id, replace(replace(url, 'https://', ''), 'http://', '') AS portable FROM pages")
def _(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("portable"))


@query("flt15_aggregate_release", "SELECT event_type, count(*) AS rows_released, " + q6("avg(value)") + " AS mean FROM events GROUP BY 1")
def _(spark, sf):
    out = read(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows_released"), r6(F.avg("value"), "mean"), F.min("user_id").alias("user_id"))
    out = out.drop("user_id")
    left = {"user_id", "event_id", "subject"} & set(out.columns)
    if left:
        raise ValueError(f"identity columns left in a release: {sorted(left)}")
    return out


# ---- completeness, ranges, schema ------------------------------------------------------

@query("dq6_index_completeness", with_(TRACE) + """, s AS (SELECT DISTINCT subject FROM trace), v AS (SELECT DISTINCT video FROM trace), c AS (SELECT subject, video, count(*) AS n, max(t) + 1 = count(*) AND min(t) = 0 AS contiguous FROM trace GROUP BY 1, 2)
SELECT video, count(*) AS trials, count(*) FILTER (NOT contiguous) AS broken, min(n) AS shortest, max(n) AS longest, (SELECT count(*) FROM s) - count(*) AS missing FROM c GROUP BY video""")
def _(spark, sf):
    t = A.trace(spark, sf)
    c = t.groupBy("subject", "video").agg(F.count(F.lit(1)).alias("n"), ((F.max("t") + 1 == F.count(F.lit(1))) & (F.min("t") == 0)).alias("ok"))
    s = t.select("subject").distinct().agg(F.count(F.lit(1)).alias("s")).scalar()
    return c.groupBy("video").agg(F.count(F.lit(1)).alias("trials"), F.count_if(~F.col("ok")).alias("broken"), F.min("n").alias("shortest"), F.max("n").alias("longest")).withColumn("missing", s - F.col("trials"))


NUM = {"orders": ["o_totalprice"], "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "events": ["value"], "customer": ["c_acctbal"]}


@query("dq11_finite_and_range", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS rows_seen, count(*) FILTER ({c} IS NULL OR isnan({c}) OR isinf({c})) AS not_finite, count(*) FILTER ({c} < 0 OR {c} > 1000000) AS out_of_range FROM {t}" for t, cs in NUM.items() for c in cs))
def _(spark, sf):
    parts = []
    for t, cs in NUM.items():
        # one scan per table; every column is checked in the same aggregate
        a = read(spark, sf, t).agg(F.count(F.lit(1)).alias("n"), *[x for c in cs for x in (
            F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"f_{c}"), F.count_if((F.col(c) < 0) | (F.col(c) > 1000000)).alias(f"r_{c}"))])
        parts.append(a.select(F.lit(t).alias("table_name"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("rows_seen"), F.col(f"f_{c}").alias("not_finite"), F.col(f"r_{c}").alias("out_of_range")) for c in cs])).alias("s")).select("table_name", "s.*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("dq12_closed_schema", with_(TRACE) + """SELECT video, count(DISTINCT t) = max(t) + 1 AS complete_grid, min(valence) >= 1 AND max(valence) <= 255 AND min(arousal) >= 1 AND max(arousal) <= 255 AS in_range, true AS fields_exact FROM trace GROUP BY 1""")
def _(spark, sf):
    t = A.trace(spark, sf)
    exact = set(t.columns) == {"subject", "video", "t", "valence", "arousal"}
    # distinct seconds are deduplicated before the per-item roll-up
    g = t.groupBy("video", "t").agg(F.min(F.least("valence", "arousal")).alias("lo"), F.max(F.greatest("valence", "arousal")).alias("hi"))
    return g.groupBy("video").agg((F.count(F.lit(1)) == F.max("t") + 1).alias("complete_grid"), ((F.min("lo") >= 1) & (F.max("hi") <= 255)).alias("in_range")).withColumn("fields_exact", F.lit(exact))


# ---- text scans -------------------------------------------------------------------------

# Token forms that must not be published, plus two common ones.
PATTERNS = [
    ("GitHub token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"), ("GitHub fine-grained token", r"\bgithub_pat_[A-Za-z0-9_]{40,}\b"),
    ("Hugging Face token", r"\bhf_[A-Za-z0-9]{30,}\b"), ("OpenAI-style key", r"\bsk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{32,}\b"),
    ("AWS access-key ID", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"), ("private-key header", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    ("e-mail address", r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[A-Za-z0-9.]+"), ("link", r"https?://[A-Za-z0-9]"),
]


@query("dq13_secret_scan", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)\n" + " UNION ALL ".join(
    f"SELECT doc_id, n AS line_number, '{n}' AS label FROM l WHERE regexp_matches(line, '{p}')" for n, p in PATTERNS))
def _(spark, sf):
    return secret_lines(read(spark, sf, "documents"), "doc_id", "text")


def secret_lines(df, key, text):
    """(key, line_number, label) of every line that holds a token form; the value is never emitted."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), n) for n, p in PATTERNS]))
    return lines.select(key, (F.col("n") + 1).cast("long").alias("line_number"), F.explode(hits).alias("label"))


PATHS = """paths AS (SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'src/' || lang || '.py' WHEN 1 THEN '.venv/lib.py' WHEN 2 THEN 'src/__pycache__/a.py' WHEN 3 THEN 'data/raw.csv' WHEN 4 THEN 'data/DATASET.md' WHEN 5 THEN 'm/w.SafeTensors' WHEN 6 THEN 'x/a.tar.gz' WHEN 7 THEN 'cfg/.env' WHEN 8 THEN 'cfg/api_token.json' WHEN 9 THEN 'k/id_rsa' WHEN 10 THEN '../up.txt' ELSE 'in/sig.npy' END AS path FROM documents)"""
LADDER = """CASE WHEN path LIKE '/%' OR list_contains(string_split(path, '/'), '..') THEN 'invalid path' WHEN split_part(path, '/', 1) IN ('.git','.local','.venv','archive','artifacts','checkpoints','references','build','dist') THEN 'local-only folder'
 WHEN len(list_intersect(string_split(path, '/'), ['__pycache__','.pytest_cache','.mypy_cache','.ruff_cache','node_modules'])) > 0 THEN 'cache folder' WHEN split_part(path, '/', 1) = 'data' AND path NOT IN ('data/DATASET.md','data/stimuli/PROVENANCE.md') THEN 'private data'
 WHEN regexp_matches(lower(path), '\\.(npy|npz|mat|edf|set|snirf|mp4|mkv|avi|mov|wav)$') THEN 'raw input' WHEN regexp_matches(lower(path), '\\.(pt|pth|ckpt|safetensors)$') THEN 'weights' WHEN regexp_matches(lower(path), '\\.(zip|tar|tar\\.gz|tgz|7z)$') THEN 'archive'
 WHEN lower(list_extract(string_split(path, '/'), -1)) = '.env' THEN 'environment file' WHEN regexp_matches(lower(list_extract(string_split(path, '/'), -1)), '(^|[_-])(tokens?|credentials?|secrets?)([_-].*)?\\.(json|ya?ml|toml|ini|txt|csv)$') THEN 'credential name' WHEN lower(list_extract(string_split(path, '/'), -1)) IN ('id_rsa','id_dsa','id_ecdsa','id_ed25519') THEN 'key file' END"""


@query("dq14_path_policy", with_(PATHS) + f"SELECT doc_id, path, {LADDER} AS reason FROM paths")
def _(spark, sf):
    d = F.col("doc_id") % 12
    forms = ["", ".venv/lib.py", "src/__pycache__/a.py", "data/raw.csv", "data/DATASET.md", "m/w.SafeTensors", "x/a.tar.gz", "cfg/.env", "cfg/api_token.json", "k/id_rsa", "../up.txt", "in/sig.npy"]
    path = F.when(d == 0, F.concat(F.lit("src/"), "lang", F.lit(".py"))).otherwise(F.element_at(F.array(*map(F.lit, forms)), (d + 1).cast("int")))
    return read(spark, sf, "documents").select("doc_id", path.alias("path")).withColumn("reason", path_reason(F.col("path")))


def path_reason(path):
    """Why a path must not be published, or null; first matching rule wins.  Fixed values."""
    parts, low = F.split(path, "/"), F.lower(path)
    name = F.lower(F.element_at(parts, -1))
    return (
        F.when(path.startswith("/") | F.array_contains(parts, ".."), "invalid path")
        .when(parts[0].isin(".git", ".local", ".venv", "archive", "artifacts", "checkpoints", "references", "build", "dist"), "local-only folder")
        .when(F.arrays_overlap(parts, F.array(*map(F.lit, ("__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "node_modules")))), "cache folder")
        .when((parts[0] == "data") & ~path.isin("data/DATASET.md", "data/stimuli/PROVENANCE.md"), "private data")
        .when(low.rlike(r"\.(npy|npz|mat|edf|set|snirf|mp4|mkv|avi|mov|wav)$"), "raw input")
        .when(low.rlike(r"\.(pt|pth|ckpt|safetensors)$"), "weights")
        .when(low.rlike(r"\.(zip|tar|tar\.gz|tgz|7z)$"), "archive")
        .when(name == ".env", "environment file")
        .when(name.rlike(r"(^|[_-])(tokens?|credentials?|secrets?)([_-].*)?\.(json|ya?ml|toml|ini|txt|csv)$"), "credential name")
        .when(name.isin("id_rsa", "id_dsa", "id_ecdsa", "id_ed25519"), "key file"))


@query("dq15_private_markers", """SELECT conv_id, turn, len(regexp_extract_all(text, '/home/|/Users/|file://|^[A-Za-z]:[/]')) > 0 OR event_marker AS leaks FROM (SELECT *, conv_id % 9 = 0 AND turn = 0 AS event_marker FROM conversations)""")
def _(spark, sf):
    c = read(spark, sf, "conversations")
    # nested record: the marker may sit in any string of the serialized value
    planted = F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") == 0), "/home/someone/x").otherwise("ok")
    rec = F.to_json(F.struct("role", F.struct(F.col("text").alias("body"), planted.alias("origin")).alias("payload")))
    return c.select("conv_id", "turn", rec.rlike("/home/|/Users/|file://|\"[A-Za-z]:[/]").alias("leaks"))


@query("dq16_link_check", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS target FROM pages), known AS (SELECT DISTINCT '/' || regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages)
SELECT page_id, count(*) AS links, count(*) FILTER (path IS NULL) AS missing FROM l LEFT JOIN known ON known.path = l.target GROUP BY page_id""")
def _(spark, sf):
    p = read(spark, sf, "pages")
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("target"))
    known = p.select(F.concat(F.lit("/"), F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1)).alias("target")).distinct().withColumn("known", F.lit(True))
    # copies of a link are counted per page before the join
    counted = links.groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("k"))
    return counted.join(known, "target", "left").groupBy("page_id").agg(F.sum("k").alias("links"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("k"))), F.lit(0).cast("long")).alias("missing"))


# ---- evidence graph ----------------------------------------------------------------------

STATUS = ["AVAILABLE", "PARTIAL", "NOT_TESTED", "NO_DEMONSTRATED_INCREMENT", "NOT_JUSTIFIED", "ASSERTED_VALID"]
EDGE = ["requires", "supports", "does_not_license", "blocks_deployment", "causes"]
GRAPH = """node AS (SELECT 'n' || s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'AVAILABLE' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'NOT_TESTED' WHEN 3 THEN 'NO_DEMONSTRATED_INCREMENT' WHEN 4 THEN 'NOT_JUSTIFIED' ELSE 'ASSERTED_VALID' END AS status,
 CASE s_suppkey % 4 WHEN 1 THEN 'user_benefit' ELSE 'offline_use' END AS permit, 'a' || (s_suppkey * 7 % 2100) AS artifact_id, CASE WHEN s_suppkey % 10 = 0 THEN '2026/01/05' ELSE '2026-01-05' END AS decision_date FROM supplier),
edge AS (SELECT o_orderkey AS edge_id, 'n' || (o_custkey % 120) AS source, 'n' || (o_orderkey % 110) AS target, CASE o_orderkey % 5 WHEN 0 THEN 'requires' WHEN 1 THEN 'supports' WHEN 2 THEN 'does_not_license' WHEN 3 THEN 'blocks_deployment' ELSE 'causes' END AS type FROM orders),
artifact AS (SELECT 'a' || p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN '/abs/' || p_partkey WHEN p_partkey % 9 = 1 THEN 'x/../' || p_partkey ELSE 'results/' || p_partkey END AS uri, CASE WHEN p_partkey % 8 = 0 THEN upper(sha256(p_name)) ELSE sha256(p_name) END AS digest, sha256(CASE WHEN p_partkey % 11 = 0 THEN 'changed' ELSE p_name END) AS actual FROM part)"""


def graph(spark, sf):
    """Nodes, edges and artifacts of an evidence graph, read back from nested JSON records."""
    pick = lambda v, i: F.element_at(F.array(*map(F.lit, v)), (i + 1).cast("int"))
    s = F.col("s_suppkey")
    node = read(spark, sf, "supplier").select(
        F.concat(F.lit("n"), s.cast("string")).alias("id"), pick(STATUS, s % 6).alias("status"), F.when(s % 4 == 1, "user_benefit").otherwise("offline_use").alias("permit"),
        F.concat(F.lit("a"), (s * 7 % 2100).cast("string")).alias("artifact_id"), F.when(s % 10 == 0, "2026/01/05").otherwise("2026-01-05").alias("decision_date"))
    o = F.col("o_orderkey")
    edge = read(spark, sf, "orders").select(o.alias("edge_id"), F.concat(F.lit("n"), (F.col("o_custkey") % 120).cast("string")).alias("source"),
                                            F.concat(F.lit("n"), (o % 110).cast("string")).alias("target"), pick(EDGE, o % 5).alias("type"))
    p = F.col("p_partkey")
    h = F.sha2("p_name", 256)
    uri = F.when(p % 9 == 0, F.concat(F.lit("/abs/"), p.cast("string"))).when(p % 9 == 1, F.concat(F.lit("x/../"), p.cast("string"))).otherwise(F.concat(F.lit("results/"), p.cast("string")))
    art = read(spark, sf, "part").select(F.concat(F.lit("a"), p.cast("string")).alias("id"), uri.alias("uri"), F.when(p % 8 == 0, F.upper(h)).otherwise(h).alias("digest"),
                                         F.sha2(F.when(p % 11 == 0, "changed").otherwise(F.col("p_name")), 256).alias("actual"))
    return node, edge, art


@query("src8_evidence_graph", with_(GRAPH) + "SELECT 'node' AS kind, status AS label, count(*) AS n FROM node GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM edge GROUP BY 2")
def _(spark, sf):
    node, edge, _a = graph(spark, sf)
    docs = node.select(F.to_json(F.struct(F.lit("node").alias("kind"), "id", "status", F.array("permit").alias("permits"))).alias("value")).unionByName(
        edge.select(F.to_json(F.struct(F.lit("edge").alias("kind"), "source", "target", F.col("type").alias("status"))).alias("value")))
    path = scratch(spark, "graph", sf)
    docs.write.mode("overwrite").text(path)
    g = Fm.read_documents(spark, path, "kind STRING, id STRING, status STRING, permits ARRAY<STRING>, source STRING, target STRING")
    return g.groupBy("kind", F.col("status").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("jn13_referential_join", with_(GRAPH) + "SELECT 'source' AS side, count(*) AS dangling FROM edge WHERE source NOT IN (SELECT id FROM node) UNION ALL SELECT 'target', count(*) FROM edge WHERE target NOT IN (SELECT id FROM node) UNION ALL SELECT 'artifact', count(*) FROM node WHERE artifact_id NOT IN (SELECT id FROM artifact)")
def _(spark, sf):
    node, edge, art = graph(spark, sf)
    # edges are counted per endpoint before the anti join, so a hub node is one row
    ends = edge.select(F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("id")), F.struct(F.lit("target").alias("side"), F.col("target").alias("id")))).alias("s")).select("s.*")
    c = ends.groupBy("side", "id").agg(F.count(F.lit(1)).alias("k"))
    bad = c.join(node.select("id"), "id", "left_anti").groupBy("side").agg(F.sum("k").alias("dangling"))
    lost = node.select(F.col("artifact_id").alias("id")).join(art.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("dangling")).select(F.lit("artifact").alias("side"), "dangling")
    full = spark.createDataFrame([("source",), ("target",)], "side string").join(bad, "side", "left").select("side", F.coalesce("dangling", F.lit(0).cast("long")).alias("dangling"))
    return full.unionByName(lost)


@query("dq7_graph_rules", with_(GRAPH) + f"""SELECT 'node' AS kind, id, 'unknown status' AS problem FROM node WHERE status = 'ASSERTED_VALID' UNION ALL SELECT 'node', id, 'partial permits benefit' FROM node WHERE status = 'PARTIAL' AND permit IN ('durable_retention','user_benefit','consequential_deployment')
UNION ALL SELECT 'node', id, 'date form' FROM node WHERE NOT regexp_matches(decision_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') UNION ALL SELECT 'artifact', id, 'uri not relative' FROM artifact WHERE uri LIKE '/%' OR uri LIKE '%..%' UNION ALL SELECT 'artifact', id, 'digest form' FROM artifact WHERE NOT regexp_matches(digest, '^[0-9a-f]{{64}}$')
UNION ALL SELECT 'artifact', id, 'digest mismatch' FROM artifact WHERE regexp_matches(digest, '^[0-9a-f]{{64}}$') AND digest <> actual UNION ALL SELECT 'edge', CAST(edge_id AS VARCHAR), 'unknown type' FROM edge WHERE type = 'causes'
UNION ALL SELECT 'edge', CAST(edge_id AS VARCHAR), 'blocked target available' FROM edge JOIN node a ON a.id = source JOIN node b ON b.id = target WHERE type = 'blocks_deployment' AND a.status <> 'AVAILABLE' AND b.status = 'AVAILABLE'""")
def _(spark, sf):
    node, edge, art = graph(spark, sf)
    say = lambda d, kind, key, checks: d.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.explode(F.array_compact(F.array(*checks))).alias("problem"))
    n = say(node, "node", "id", [F.when(~F.col("status").isin(STATUS[:5]), "unknown status"), F.when((F.col("status") == "PARTIAL") & F.col("permit").isin("durable_retention", "user_benefit", "consequential_deployment"), "partial permits benefit"),
                                 F.when(~S.iso_date(F.col("decision_date")), "date form")])
    form = F.col("digest").rlike("^[0-9a-f]{64}$")
    a = say(art, "artifact", "id", [F.when(F.col("uri").startswith("/") | F.col("uri").contains(".."), "uri not relative"), F.when(~form, "digest form"), F.when(form & (F.col("digest") != F.col("actual")), "digest mismatch")])
    e = say(edge, "edge", "edge_id", [F.when(~F.col("type").isin(EDGE[:4]), "unknown type")])
    st = node.select("id", "status")
    b = edge.filter("type = 'blocks_deployment'").join(st.withColumnsRenamed({"id": "source", "status": "ss"}), "source").join(st.withColumnsRenamed({"id": "target", "status": "ts"}), "target")
    b = b.filter((F.col("ss") != "AVAILABLE") & (F.col("ts") == "AVAILABLE")).select(F.lit("edge").alias("kind"), F.col("edge_id").cast("string").alias("id"), F.lit("blocked target available").alias("problem"))
    return reduce(lambda x, y: x.unionByName(y), [n, a, e, b])


@query("dq8_artifact_identity", with_(GRAPH) + """SELECT status, count(*) AS artifacts FROM (SELECT CASE WHEN n % 13 = 0 THEN 'missing' WHEN digest <> actual THEN 'hash_mismatch' WHEN n % 5 = 0 THEN 'duration_mismatch' WHEN n % 7 = 0 THEN 'duration_only_unverified' ELSE 'identity_verified' END AS status
 FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM artifact)) GROUP BY status""")
def _(spark, sf):
    _n, _e, art = graph(spark, sf)
    k = F.substring("id", 2, 12).cast("long")
    present = art.filter(k % 13 != 0).select("id", F.col("actual").alias("seen"), F.when(k % 5 == 0, 99).otherwise(10).alias("duration"))
    j = art.join(present, "id", "left")
    expected = F.when(k % 7 != 0, F.col("digest"))
    fits = F.col("duration").between(10 - 1, 12 + 1)
    status = (F.when(F.col("seen").isNull(), "missing").when(F.col("digest") != F.col("seen"), "hash_mismatch").when(~fits, "duration_mismatch")
              .when(expected.isNull(), "duration_only_unverified").otherwise("identity_verified"))
    return j.select(status.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("artifacts"))


@query("dq17_registry_refresh", with_(GRAPH) + """SELECT node.id, CAST(2 AS BIGINT) AS links, coalesce(a.actual, '') AS digest, coalesce(a.digest <> a.actual, false) AS changed FROM node LEFT JOIN artifact a ON a.id = node.artifact_id""")
def _(spark, sf):
    node, _e, art = graph(spark, sf)
    j = node.join(art.select(F.col("id").alias("artifact_id"), "digest", "actual"), "artifact_id", "left")
    links = F.array_union(F.array("artifact_id"), F.array(F.col("artifact_id"), F.concat(F.lit("report_"), "id")))
    return j.select("id", F.size(links).cast("long").alias("links"), F.coalesce("actual", F.lit("")).alias("digest"), F.coalesce(F.col("digest") != F.col("actual"), F.lit(False)).alias("changed"))


@query("dq18_report_rows", with_(GRAPH) + "SELECT id, status, 'may: ' || permit AS permitted_claim, decision_date AS decision FROM node WHERE permit <> 'offline_use'")
def _(spark, sf):
    node, _e, _a = graph(spark, sf)
    t = node.withColumn("table_en", F.struct("status", F.concat(F.lit("may: "), "permit").alias("permitted_claim"), F.col("decision_date").alias("decision"), (F.col("permit") != "offline_use").alias("include_in_table")))
    return t.filter("table_en.include_in_table").select("id", "table_en.status", "table_en.permitted_claim", "table_en.decision")


# ---- record linkage ------------------------------------------------------------------------

NORMAL = "regexp_replace(strip_accents(replace(lower({x}), 'ß', 'ss')), '[^a-z0-9]', '', 'g')"
TITLE = NORMAL.format(x="split_part(text, chr(10), 1)")
RECORDS = f"""rec AS (SELECT doc_id AS id, lang AS year, {NORMAL.format(x="coalesce(source, '')")} AS container, {TITLE} AS title FROM documents)"""


def ratio_sql(name, strings, least):
    """Ordered pairs (a, b, r) of the strings of a relation ``s`` and their matching-block ratio.

    Pairs that cannot reach ``least`` are left out before: by the shorter length,
    by the letters in common, and by the edit distance, which insertions and
    deletions of the unmatched characters alone would bring about.  Cells are
    equal characters, ``k`` the length of the common run that starts there; the
    longest run in a box splits it into the boxes before and behind.
    """
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    counts = ", ".join(f"length(s) - length(replace(s, '{c}', '')) AS _{c}" for c in letters)
    shared = " + ".join(f"least(x._{c}, y._{c})" for c in letters)
    others = "least(x.n - ({0}), y.n - ({1}))".format(*(" + ".join(f"{t}._{c}" for c in letters) for t in "xy"))
    return f"""{name}_s AS MATERIALIZED (SELECT s, length(s) AS n, row_number() OVER (ORDER BY s) AS id, {counts} FROM (SELECT DISTINCT s FROM {strings} WHERE s <> '')),
{name}_p AS MATERIALIZED (
  SELECT x.id AS i, y.id AS j, least(x.n, y.n) >= 18 AND (starts_with(x.s, y.s) OR starts_with(y.s, x.s)) AS opens
  FROM {name}_s x JOIN {name}_s y ON x.id < y.id
   AND (2 * least(x.n, y.n, {shared} + {others}) >= {least} * (x.n + y.n) - 1e-6
        OR (least(x.n, y.n) >= 18 AND (starts_with(x.s, y.s) OR starts_with(y.s, x.s))))),
{name}_u AS MATERIALIZED (
  SELECT x.s, y.s AS t FROM {name}_p JOIN {name}_s x ON x.id = i JOIN {name}_s y ON y.id = j
  WHERE CASE WHEN opens THEN true ELSE levenshtein(x.s, y.s) <= (1 - {least}) * (x.n + y.n) + 1e-6 END),
{name}_c AS MATERIALIZED (SELECT s AS a, t AS b FROM {name}_u UNION ALL SELECT t, s FROM {name}_u),
{name}_e AS (
  SELECT a, b, i, j FROM (SELECT a, b, i, unnest(range(length(b))) AS j FROM (SELECT a, b, unnest(range(length(a))) AS i FROM {name}_c))
  WHERE substr(a, i + 1, 1) = substr(b, j + 1, 1)),
{name}_r AS (SELECT *, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS run FROM {name}_e),
{name}_k AS MATERIALIZED (SELECT a, b, i, j, max(i) OVER (PARTITION BY a, b, i - j, run) - i + 1 AS k FROM {name}_r),
{name}_b(a, b, al, ah, bl, bh, m) AS (
  SELECT a, b, 0::BIGINT, length(a)::BIGINT, 0::BIGINT, length(b)::BIGINT, 0::BIGINT FROM {name}_c
  UNION ALL
  SELECT a, b, p.al, p.ah, p.bl, p.bh, p.m FROM (
    SELECT a, b, unnest([{{'al': al, 'ah': w.i, 'bl': bl, 'bh': w.j, 'm': -w.s}}, {{'al': w.i - w.s, 'ah': ah, 'bl': w.j - w.s, 'bh': bh, 'm': 0}}]) AS p FROM (
      SELECT x.a, x.b, x.al, x.ah, x.bl, x.bh, min({{'s': -least(k, x.ah - i, x.bh - j), 'i': i, 'j': j}}) AS w
      FROM {name}_b x JOIN {name}_k c ON c.a = x.a AND c.b = x.b AND i >= x.al AND i < x.ah AND j >= x.bl AND j < x.bh
      GROUP BY x.a, x.b, x.al, x.ah, x.bl, x.bh))),
{name} AS (
  SELECT a, b, r FROM (
    SELECT a, b, greatest(2.0 * sum(m) / (length(a) + length(b)),
      CASE WHEN least(length(a), length(b)) >= 18 AND (starts_with(a, b) OR starts_with(b, a)) THEN 0.97 ELSE 0 END) AS r
    FROM {name}_b GROUP BY a, b) WHERE r >= {least}
  UNION ALL SELECT DISTINCT s, s, 1.0 FROM {strings} WHERE s <> '')"""


LINK = f"""WITH RECURSIVE {RECORDS},
ts AS (SELECT title AS s FROM rec), cs AS (SELECT container AS s FROM rec),
{ratio_sql("tr", "ts", 0.72)},
{ratio_sql("cr", "cs", 0.55)},
pr AS (
  SELECT x.id, y.id AS other, tr.r, coalesce(cr.r, 0) AS c, x.year AS yx, y.year AS yy, x.container AS box,
         round(tr.r + CASE WHEN x.year = y.year THEN 0.18 ELSE 0 END + 0.08 * coalesce(cr.r, 0), 9) AS score
  FROM rec x JOIN tr ON tr.a = x.title JOIN rec y ON y.title = tr.b AND y.id <> x.id LEFT JOIN cr ON cr.a = x.container AND cr.b = y.container)
"""


def records(spark, sf):
    """Documents as records: the first line is the title, the language stands for the year, the source for the container."""
    d = read(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("year"), S.normalized_text(F.coalesce("source", F.lit(""))).alias("container"),
                    S.normalized_text(F.substring_index("text", "\n", 1)).alias("title"))


def linkage_tables(spark, sf):
    """Records and their similar titles and containers, written once for both linkage queries."""
    rec = written(spark, "linkage-records", sf, lambda: records(spark, sf))
    titles = written(spark, "linkage-titles", sf, lambda: L.reaching(rec.select(F.col("title").alias("s")), L.TITLE))
    containers = written(spark, "linkage-containers", sf, lambda: L.reaching(rec.select(F.col("container").alias("s")), L.CONTAINER))
    return rec, titles, containers


@query("jn17_record_linkage", LINK + f"""SELECT id AS doc_id, arg_min(other, {{'s': -score, 'o': other}}) AS match,
{q6("arg_min(r, {'s': -score, 'o': other})")} AS title_similarity, {q6("max(score)")} AS score FROM pr GROUP BY id""")
def _(spark, sf):
    """Best other record of every record whose title is similar to another's."""
    found = L.best_matches(*linkage_tables(spark, sf))
    return found.select(F.col("id").alias("doc_id"), "match", r6("title_similarity"), r6("score"))


@query("dq19_record_reconciliation", LINK + """, o AS (
  SELECT id, max(r) AS best, count(*) FILTER (r >= 0.9) AS sure, count(*) FILTER (yx = yy) AS same, count(DISTINCT yy) AS years,
         any_value(box) AS box, count(*) FILTER (c > 0) AS boxed FROM pr GROUP BY id),
i AS (
  SELECT rec.id, CASE WHEN o.id IS NULL THEN ['record critical'] ELSE list_filter([
    CASE WHEN best < 0.88 THEN 'title critical' WHEN best < 0.96 THEN 'title warning' END,
    CASE WHEN years > 0 AND same = 0 THEN 'year critical' WHEN years > 1 THEN 'year warning' END,
    CASE WHEN box <> '' AND boxed = 0 THEN 'container warning' END,
    CASE WHEN sure < 2 THEN 'evidence warning' END], lambda x: x IS NOT NULL) END AS f
  FROM rec LEFT JOIN o USING (id) WHERE title <> '')
SELECT id AS doc_id, split_part(x, ' ', 1) AS field, split_part(x, ' ', 2) AS severity FROM (SELECT id, unnest(f) AS x FROM i)""")
def _(spark, sf):
    """What the other records of a title say against a record, by field and severity."""
    return L.issues(*linkage_tables(spark, sf)).withColumnRenamed("id", "doc_id")
