"""All queries over the test tables and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as fn
from quillstone.operators import answers, catalog, sessions, state, storage
from quillstone import shared
from quillstone.plans import bindings as b
from quillstone.sources import library_json
from quillstone.streaming import live

QUERIES: dict = {}
ORACLES: dict = {}

# The oracles' view of the bindings.
_NOTEBOOK = """notebook AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, 'https://notes.example.org/' || p_partkey AS url, p_name AS name, p_type AS description,
    string_split(p_name, ' ') AS topics, [p_brand] AS tags, p_partkey AS ordinal FROM part)"""
_OBS = "obs AS (SELECT user_id AS key, ts, event_id AS seq, event_type AS text, event_type = 'error' AS thinking FROM events)"
_FILES = """files AS (
  SELECT CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 6
      WHEN 0 THEN 'browser_state/' || source || '/doc' || doc_id WHEN 1 THEN 'sessions.json' WHEN 2 THEN 'library.json'
      WHEN 3 THEN 'auth_info.json' WHEN 4 THEN 'cache/doc' || doc_id ELSE 'doc' || doc_id END AS path,
    octet_length(encode(text)) AS size FROM documents),
items AS (
  SELECT category, path, type, CAST(sum(size) AS BIGINT) AS size FROM (
    SELECT CASE split_part(path, '/', 1) WHEN 'browser_state' THEN 'browser_state' WHEN 'sessions.json' THEN 'sessions'
        WHEN 'library.json' THEN 'library' WHEN 'auth_info.json' THEN 'auth' ELSE 'other' END AS category,
      CASE WHEN split_part(path, '/', 1) = 'browser_state' THEN 'browser_state/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS path,
      CASE WHEN len(string_split(path, '/')) > (CASE WHEN split_part(path, '/', 1) = 'browser_state' THEN 2 ELSE 1 END) THEN 'dir' ELSE 'file' END AS type, size
    FROM files) GROUP BY ALL)""".replace("\\\\", "\\")
_SIZE_TEXT = """CASE WHEN n < 1024 THEN printf('%.1f B', CAST(n AS DOUBLE)) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0)
  WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END"""
_NOW = f"TIMESTAMP '{b.AS_OF}'"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _matching(condition: str) -> str:
    return f"WITH {_NOTEBOOK} SELECT id, name, description FROM notebook WHERE {condition}"


def _contains(q: str) -> str:
    texts = ("name", "description", "array_to_string(topics, ' ')", "array_to_string(tags, ' ')")
    return " OR ".join(f"contains(lower({t}), '{q}')" for t in texts)


# Catalogue reads


@_query(_matching(_contains("ring")))
def lib_search(spark, d):
    return catalog.search(b.catalog(spark, d), "RING").select("id", "name", "description")


@_query(_matching(_contains("red ring")))
def lib_search_phrase(spark, d):
    return catalog.search(b.catalog(spark, d).withColumn("name", F.lit("x")), "Red Ring").select("id", F.array_join("topics", " ").alias("name"), "description")


@_query(_matching("TRUE"))
def lib_search_empty(spark, d):
    return catalog.search(b.catalog(spark, d), "").select("id", "name", "description")


@_query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'tion ') OR contains(lower(lang), 'tion ') OR contains(lower(source), 'tion ')")
def lib_search_text(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", F.lit("").alias("name"), F.col("text").alias("description"), F.array("lang").alias("topics"), F.array("source").alias("tags"), F.array().cast("array<string>").alias("use_cases"))
    return catalog.search(docs, "TION ").select("doc_id", F.get("topics", F.lit(0)).alias("lang"), F.get("tags", F.lit(0)).alias("source"))


@_query(f"WITH {_NOTEBOOK} SELECT id, name, ordinal FROM notebook")
def lib_list(spark, d):
    return catalog.in_order(b.catalog(spark, d)).select("id", "name", "ordinal")


@_query(f"WITH {_NOTEBOOK} SELECT id, url, name, description FROM notebook WHERE id = '42'")
def lib_get(spark, d):
    return catalog.get(b.catalog(spark, d), "42").select("id", "url", "name", "description")


@_query(f"WITH {_NOTEBOOK} SELECT s.active_id, n.name, n.url FROM (SELECT '7' AS active_id UNION ALL SELECT 'gone') s LEFT JOIN notebook n ON n.id = s.active_id")
def lib_active(spark, d):
    both = b.state(spark, "7").union(b.state(spark, "gone"))
    return catalog.active(b.catalog(spark, d), both).select("active_id", "name", "url")


@_query(f"WITH {_NOTEBOOK} SELECT id, name || CASE WHEN id = '7' THEN ' [ACTIVE]' ELSE '' END AS title, array_to_string(topics, ', ') AS topics, CAST(0 AS BIGINT) AS uses FROM notebook")
def lib_render(spark, d):
    return catalog.render(b.catalog(spark, d), b.state(spark))


@_query("SELECT p_partkey, translate(lower(p_name || '_' || p_type), ' _', '--') AS slug FROM part")
def lib_slug(spark, d):
    return b.table(spark, d, "part").select("p_partkey", fn.slug(F.concat("p_name", F.lit("_"), "p_type")).alias("slug"))


@_query("SELECT translate(lower(p_name), ' _', '--') AS slug, count(*) AS n, arg_min(CAST(p_partkey AS VARCHAR), p_partkey) AS first_id FROM part GROUP BY 1 HAVING count(*) > 1")
def lib_slug_conflicts(spark, d):
    return catalog.slug_conflicts(b.catalog(spark, d))


@_query("SELECT p_partkey, [trim(p_name), '', trim(p_brand), trim(p_type), ''] AS topics, CAST([] AS VARCHAR[]) AS tags FROM part")
def lib_parse_topics(spark, d):
    field = F.concat("p_name", F.lit(",, "), "p_brand", F.lit(" ,\t"), "p_type", F.lit(" ,"))
    return b.table(spark, d, "part").select("p_partkey", fn.parse_list(field).alias("topics"), fn.parse_optional_list(F.lit("")).alias("tags"))


# Statistics


@_query("SELECT CAST(p_partkey AS VARCHAR) AS id, count(l_partkey) AS use_count, max(l_shipdate) AS last_used FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def lib_usage(spark, d):
    return catalog.with_usage(b.catalog(spark, d), b.usage_log(spark, d)).select("id", "use_count", "last_used")


_USED = f"{_NOTEBOOK}, used AS (SELECT id, ordinal, (SELECT count(*) FROM lineitem WHERE CAST(l_partkey AS VARCHAR) = id) AS use_count FROM notebook)"


@_query(f"""WITH {_USED} SELECT (SELECT count(*) FROM notebook) AS total_notebooks,
  (SELECT count(DISTINCT t) FROM (SELECT unnest(topics) AS t FROM notebook)) AS total_topics, CAST((SELECT sum(use_count) FROM used) AS BIGINT) AS total_use_count,
  a.id AS active_notebook, a.name AS active_name, a.url AS active_url, a.use_count AS active_use_count, a.topics AS active_topics,
  m.id AS most_used_notebook, m.name AS most_used_name, m.url AS most_used_url, m.use_count AS most_used_use_count, m.topics AS most_used_topics, 'part' AS library_path
  FROM (SELECT n.*, used.use_count FROM notebook n JOIN used USING (id) WHERE id = '7') a, (SELECT n.*, used.use_count FROM notebook n JOIN used USING (id) ORDER BY used.use_count DESC, n.ordinal LIMIT 1) m""")
def lib_stats(spark, d):
    out = catalog.stats(catalog.with_usage(b.catalog(spark, d), b.usage_log(spark, d)), b.state(spark), "part")
    records = [F.col(f"{which}_record.{c}").alias(f"{which}_{c}") for which in ("active", "most_used") for c in ("name", "url", "use_count", "topics")]
    return out.select("total_notebooks", "total_topics", "total_use_count", "active_notebook", "most_used_notebook", *records, "library_path")


@_query(f"WITH {_NOTEBOOK} SELECT count(*) AS n_results FROM notebook WHERE contains(lower(name), 'green')")
def lib_search_count(spark, d):
    return catalog.search_count(catalog.search(b.catalog(spark, d).select("id", "name", F.lit("").alias("description"), *[F.array().cast("array<string>").alias(c) for c in catalog.LISTS]), "GREEN"))


@_query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS topic FROM part")
def lib_topics_distinct(spark, d):
    return catalog.topics_distinct(b.catalog(spark, d))


@_query(f"WITH {_USED} SELECT id, use_count FROM used ORDER BY use_count DESC, ordinal LIMIT 1")
def lib_most_used(spark, d):
    return catalog.most_used(catalog.with_usage(b.catalog(spark, d), b.usage_log(spark, d))).select("id", "use_count")


# Changes


def _requests(spark, d):
    part = b.table(spark, d, "part")
    return part.select(F.col("p_name").alias("name"), F.concat(F.lit("https://new.example.org/"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_type").alias("description"), F.concat("p_brand", F.lit(", "), "p_type").alias("topics"), F.lit("").alias("tags"), F.lit(None).cast("string").alias("use_cases"), F.col("p_partkey").alias("ordinal"))


def _held(spark, d):
    """A catalogue that holds every other of the requested ids already, and the requests that are left."""
    rows = catalog.new_rows(_requests(spark, d), b.AS_OF)
    held = catalog.first_of_each(rows).filter("ordinal % 2 = 0")
    return held, rows.join(held.select("id", "ordinal"), ["id", "ordinal"], "left_anti")


@_query("""SELECT id, name, ordinal, topics FROM (
  SELECT translate(lower(p_name), ' _', '--') AS id, p_name AS name, p_partkey AS ordinal, [p_brand, p_type] AS topics, row_number() OVER (PARTITION BY translate(lower(p_name), ' _', '--') ORDER BY p_partkey) AS k FROM part) WHERE k = 1""")
def lib_insert(spark, d):
    return catalog.insert(*_held(spark, d))[0].select("id", "name", "ordinal", "topics")


@_query("""SELECT id, ordinal FROM (
  SELECT translate(lower(p_name), ' _', '--') AS id, p_partkey AS ordinal, row_number() OVER (PARTITION BY translate(lower(p_name), ' _', '--') ORDER BY p_partkey) AS k FROM part) WHERE k > 1""")
def lib_insert_rejected(spark, d):
    return catalog.insert(*_held(spark, d))[1].select("id", "ordinal")


@_query(f"WITH {_NOTEBOOK} SELECT id, name FROM notebook WHERE id <> '7'")
def lib_remove(spark, d):
    return catalog.remove(b.catalog(spark, d), "7").select("id", "name")


@_query("SELECT CAST(min(p_partkey) AS VARCHAR) AS active_id FROM part WHERE p_partkey <> 7")
def lib_remove_reassign(spark, d):
    return catalog.reassign(b.catalog(spark, d), b.state(spark), "7")


@_query(f"""WITH {_NOTEBOOK} SELECT id, name, CASE WHEN ordinal % 7 = 0 AND ordinal % 3 = 0 THEN '' ELSE description END AS description,
  CASE WHEN ordinal % 7 = 0 THEN [] ELSE tags END AS tags, CASE WHEN ordinal % 7 = 0 THEN {_NOW} ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM notebook""")
def lib_patch(spark, d):
    base = b.catalog(spark, d)
    changes = base.filter("ordinal % 7 = 0").select("id", F.lit(None).cast("string").alias("name"), F.when(F.col("ordinal") % 3 == 0, "").alias("description"), F.array().cast("array<string>").alias("tags"))
    return catalog.patch(base, changes, b.AS_OF).select("id", "name", "description", "tags", "updated_at")


@_query("SELECT * FROM (VALUES ('11', TRUE), ('7', FALSE)) v(active_id, ok)")
def lib_activate(spark, d):
    base = b.catalog(spark, d)
    return catalog.activate(base, b.state(spark), "11").union(catalog.activate(base, b.state(spark), "no such"))


@_query("""SELECT p_partkey AS request_id,
  CASE WHEN p_partkey % 4 = 0 THEN 'https://given.example.org/' WHEN p_partkey % 4 = 1 THEN 'https://notes.example.org/' || p_partkey WHEN p_partkey % 4 = 3 THEN 'https://notes.example.org/7' END AS target,
  CASE p_partkey % 4 WHEN 0 THEN 'url' WHEN 1 THEN 'id' WHEN 2 THEN 'unknown id' ELSE 'active' END AS status FROM part""")
def ask_resolve(spark, d):
    k = F.col("p_partkey") % 4
    given = F.when(k == 0, "https://given.example.org/")
    named = F.when(k <= 1, F.col("p_partkey").cast("string")).when(k == 2, F.concat(F.lit("no-"), F.col("p_partkey").cast("string")))
    requests = b.table(spark, d, "part").select(F.col("p_partkey").alias("request_id"), given.alias("url"), named.alias("notebook_id"))
    return answers.resolve_targets(requests, b.catalog(spark, d), b.state(spark))


@_query(f"WITH {_NOTEBOOK} SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, id, name, topics, CAST(0 AS BIGINT) AS use_count FROM notebook")
def lib_scan(spark, d):
    """The whole catalogue written to files in its JSON form, in bounded documents, and read from there."""
    folder = library_json.write_blocks(b.catalog(spark, d), b.state(spark), shared.new_folder(spark, "catalogue"), b.AS_OF)
    return library_json.read_blocks(spark, folder)[0].select("ordinal", "id", "name", "topics", "use_count")


# Sessions


_WINDOWS = """WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 900 SECOND THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g)
SELECT user_id AS key, min(ts) AS created_at, max(ts) AS last_activity, count(*) AS message_count FROM s GROUP BY user_id, no"""


@_query(_WINDOWS)
def sess_windows(spark, d):
    return sessions.windows(b.observations(spark, d))


@_query("""WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 900 SECOND THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS key, event_id AS seq, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM g""")
def sess_numbered(spark, d):
    return sessions.numbered(b.observations(spark, d)).select("key", "seq", F.col("session_no").cast("long").alias("session_no"))


@_query(f"""SELECT user_id AS key, min(ts) AS created_at, max(ts) AS last_activity, count(*) AS message_count, date_sub('second', min(ts), {_NOW}) AS age_seconds, date_sub('second', max(ts), {_NOW}) AS inactive_seconds FROM events GROUP BY user_id""")
def sess_info(spark, d):
    return sessions.info(b.observations(spark, d), b.AS_OF)


@_query("SELECT user_id AS key, max(ts) AS last_activity, max(ts) + INTERVAL 86400 SECOND < TIMESTAMP '2024-01-31 12:00:00' AS expired FROM events GROUP BY user_id")
def sess_expired(spark, d):
    rows = sessions.info(b.observations(spark, d), b.AS_OF)
    return sessions.expired(rows, "2024-01-31 12:00:00", 86400).select("key", "last_activity", "expired")


@_query("""WITH r AS (SELECT user_id, event_type = 'signup' AS reset, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events)
SELECT user_id AS key, CAST(epoch AS BIGINT) AS epoch, CAST(sum(CASE WHEN reset THEN 0 ELSE 1 END) AS BIGINT) AS message_count FROM r GROUP BY 1, 2""")
def sess_reset(spark, d):
    return sessions.epochs(b.observations(spark, d), F.col("text") == "signup")


@_query("""WITH r AS (SELECT *, event_type = 'error' AS ends, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM events)
SELECT user_id AS key, CAST(no AS BIGINT) AS session_no, min(ts) AS created_at, max(ts) AS last_activity, CAST(sum(CASE WHEN ends THEN 0 ELSE 1 END) AS BIGINT) AS message_count, bool_or(ends) AS closed FROM r GROUP BY 1, 2""")
def sess_close(spark, d):
    return sessions.until_closed(b.observations(spark, d), F.col("text") == "error")


# Answers


def _stable_sql(k: int, where: str) -> str:
    return f"""WITH {_OBS}, u AS (SELECT * FROM obs WHERE {where}),
c AS (SELECT *, CASE WHEN text = lag(text) OVER (PARTITION BY key ORDER BY ts, seq) THEN 0 ELSE 1 END AS changed FROM u),
r AS (SELECT *, sum(changed) OVER (PARTITION BY key ORDER BY ts, seq) AS run FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY ts, seq) AS n FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS first FROM n WHERE n = {k})
SELECT key, ts, seq, text FROM f WHERE first = 1"""


@_query(_stable_sql(4, "NOT thinking"))
def ans_stable_oneshot(spark, d):
    return answers.stable(answers.usable(b.observations(spark, d)), answers.ONE_SHOT).select("key", "ts", "seq", "text")


@_query(_stable_sql(3, "NOT thinking AND text <> 'view'"))
def ans_stable_session(spark, d):
    return answers.stable(answers.usable(b.observations(spark, d), F.lit("view")), answers.SESSION).select("key", "ts", "seq", "text")


@_query(f"WITH {_OBS} SELECT key, seq, text FROM obs WHERE NOT thinking")
def ans_thinking(spark, d):
    return answers.usable(b.observations(spark, d)).select("key", "seq", "text")


@_query(f"WITH {_OBS} SELECT key, arg_max(text, struct_pack(ts := ts, seq := seq)) AS text FROM obs WHERE NOT thinking GROUP BY key")
def ans_latest(spark, d):
    return answers.latest(b.observations(spark, d))


@_query(f"WITH {_OBS}, l AS (SELECT *, lag(text) OVER (PARTITION BY key ORDER BY ts, seq) AS before FROM obs) SELECT key, seq, text FROM l WHERE before IS NULL OR before <> text")
def ans_new(spark, d):
    return answers.unseen(b.observations(spark, d)).select("key", "seq", "text")


@_query(f"WITH {_OBS}, s AS (SELECT key, min(ts) AS started FROM obs GROUP BY key) SELECT key, seq, text FROM obs JOIN s USING (key) WHERE ts < started + INTERVAL 86400 SECOND")
def ans_deadline(spark, d):
    obs = b.observations(spark, d)
    started = obs.groupBy("key").agg(F.min("ts").alias("started"))
    return answers.before_deadline(obs.join(started, "key"), F.col("started"), 86400).select("key", "seq", "text")


_PAIRS = """l AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, text AS question, CASE WHEN next_role = 'assistant' THEN next_text END AS answer, CASE WHEN next_role = 'assistant' THEN 'success' ELSE 'error' END AS status FROM l WHERE role = 'user')"""


@_query(f"WITH {_PAIRS} SELECT * FROM p")
def ask_pairs(spark, d):
    return answers.pairs(b.turns(spark, d))


@_query(f"WITH {_PAIRS} SELECT conv_id, turn, answer, CASE WHEN answer IS NOT NULL THEN '{answers.SUFFIX}' END AS reminder FROM p")
def ask_suffix(spark, d):
    return answers.with_suffix(answers.pairs(b.turns(spark, d))).select("conv_id", "turn", "answer", "reminder")


@_query(f"WITH {_PAIRS} SELECT conv_id, turn, CASE WHEN conv_id % 5 <> 0 THEN answer END AS answer, CASE WHEN conv_id % 5 <> 0 THEN status ELSE 'error' END AS status FROM p")
def ask_gate(spark, d):
    return answers.gated(answers.pairs(b.turns(spark, d)), F.col("conv_id") % 5 != 0).select("conv_id", "turn", "answer", "status")


# State and URLs


@_query(f"""SELECT event_id, event_type <> 'error' AS authenticated,
  CASE WHEN event_type <> 'error' THEN CAST(floor(date_sub('second', ts, {_NOW}) / 3600.0) AS BIGINT) END AS state_age_hours,
  CASE WHEN event_type = 'error' THEN 'missing' WHEN date_sub('second', ts, {_NOW}) > 7 * 86400 THEN 'stale' ELSE 'ok' END AS status FROM events""")
def state_age(spark, d):
    rows = b.table(spark, d, "events")
    return state.age(rows.withColumn("modified_at", F.when(F.col("event_type") != "error", F.col("ts"))), b.AS_OF).select("event_id", "authenticated", "state_age_hours", "status")


@_query("SELECT event_id, CASE WHEN event_type = 'view' THEN FALSE ELSE TRUE END AS authenticated, CASE WHEN event_type = 'click' THEN 'saved' ELSE 'computed' END AS origin FROM events")
def state_merge(spark, d):
    rows = b.table(spark, d, "events")
    saved = F.when(F.col("event_type") == "view", F.lit(False))
    return state.overlay(rows, {"authenticated": (F.lit(True), saved), "origin": (F.lit("computed"), F.when(F.col("event_type") == "click", "saved"))}).select("event_id", "authenticated", "origin")


@_query("SELECT event_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS authenticated_at, strftime(ts, '%Y-%m-%d %H:%M:%S') AS authenticated_at_iso FROM events")
def state_ts_format(spark, d):
    return state.stamps(b.table(spark, d, "events"), "ts").select("event_id", "authenticated_at", "authenticated_at_iso")


@_query("SELECT page_id, regexp_matches(url, '^https://spam-farm\\.example\\.org/') AS on_host FROM pages")
def url_anchor(spark, d):
    return b.table(spark, d, "pages").select("page_id", fn.on_host(F.col("url"), "spam-farm.example.org").alias("on_host"))


@_query("SELECT page_id, contains(url, 'example.org') AND NOT contains(url, 'spam-farm') AS valid FROM pages")
def url_substring(spark, d):
    url = F.col("url")
    return b.table(spark, d, "pages").select("page_id", (fn.mentions(url, "example.org") & ~fn.mentions(url, "spam-farm")).alias("valid"))


_PATTERNS = ["<textarea[^>]*>([^<]*)</textarea>", "<title>([^<]*)</title>", "<h1>([^<]*)</h1>"]


@_query("SELECT page_id, coalesce(" + ", ".join(f"nullif(regexp_extract(html, '{p}', 1), '')" for p in _PATTERNS) + ", url) AS found FROM pages")
def sel_fallback(spark, d):
    return b.table(spark, d, "pages").select("page_id", fn.first_found(F.col("html"), _PATTERNS, F.col("url")).alias("found"))


# Storage


def _items(spark, d):
    return storage.items(b.files(spark, d))


@_query(f"WITH {_FILES} SELECT category, count(*) AS n_items, CAST(sum(size) AS BIGINT) AS total_size FROM items GROUP BY category")
def store_by_category(spark, d):
    return storage.by_category(_items(spark, d))


@_query(f"WITH {_FILES} SELECT count(*) AS total_items, CAST(sum(size) AS BIGINT) AS total_size FROM items")
def store_total(spark, d):
    return storage.total(_items(spark, d))


@_query(f"WITH {_FILES} SELECT category, count(*) AS n_items, CAST(sum(size) AS BIGINT) AS total_size FROM items WHERE category <> 'library' GROUP BY category")
def store_preserve(spark, d):
    return storage.by_category(storage.preserving(_items(spark, d), True))


@_query(f"WITH {_FILES} SELECT path, type, size FROM items WHERE category = 'other'")
def store_other(spark, d):
    return _items(spark, d).filter("category = 'other'").select("path", "type", "size")


@_query(f"WITH {_FILES} SELECT CAST(sum(size) AS BIGINT) AS size FROM files WHERE starts_with(path, 'browser_state/')")
def store_dir_size(spark, d):
    return storage.dir_size(b.files(spark, d), "browser_state")


@_query(f"WITH s AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents) SELECT doc_id, {_SIZE_TEXT} AS size_text FROM s")
def store_format(spark, d):
    return b.table(spark, d, "documents").select("doc_id", fn.format_size(F.octet_length("text")).alias("size_text"))


@_query(f"WITH {_FILES} SELECT TRUE AS dry_run, count(*) AS would_delete, CAST(sum(size) AS BIGINT) AS would_free FROM items WHERE category <> 'library'")
def store_dry_run(spark, d):
    return storage.dry_run(storage.preserving(_items(spark, d), True))


@_query(f"""WITH {_FILES}, c AS (SELECT category, count(*) AS n_items, CAST(sum(size) AS BIGINT) AS n FROM items GROUP BY category)
SELECT CASE category WHEN 'browser_state' THEN 'Browser State' ELSE upper(category[1]) || category[2:] END AS title, n_items, {_SIZE_TEXT} AS size_text FROM c""")
def store_preview(spark, d):
    return storage.preview(_items(spark, d))


# Streams, run to the end of what is there


def _plain(rows):
    """Time stamps as the batch forms have them."""
    return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else c for c, t in rows.dtypes])


@_query(_WINDOWS)
def stream_sessions(spark, d):
    return _plain(live.drain_sessions(spark, f"{d}/events.parquet"))


@_query("SELECT key, text, ts, 'success' AS status FROM (" + _stable_sql(3, "NOT thinking") + ")")
def stream_answers(spark, d):
    return _plain(live.drain_answers(spark, f"{d}/events.parquet"))
