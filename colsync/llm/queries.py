"""The queries of the corpus operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colsync.llm import collocations, decontaminate, filter_audit, language_id, mixing, ngram_join, pii, quality, quotations, secrets, sharding, token_counts
from colsync.llm.exact_dedup import exact_duplicates
from colsync.llm.store import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by source, language and tokenizer version; see ``token_counts``.

    All documents enter a fresh rollup in two batches, those without tokens
    too; the last is sent again and does not count twice.
    """
    scratch = Scratch(spark, "tokens")
    counted = scratch.put(token_counts.count_tokens(_table(spark, sf_dir, "documents")), "counted")
    rollup = token_counts.TokenRollup(spark, f"{scratch.path}/rollup")
    for name, changes in token_counts.document_changes(counted).items():
        rollup.apply(name, changes)
    rollup.apply(name, changes)
    return rollup.totals()


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with a Jaccard similarity of 0.9 or more on 3-word shingles; see ``ngram_join``."""
    return ngram_join.near_groups(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of all documents by source weights; see ``mixing``."""
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).drop("source")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; see ``secrets``."""
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents that lie in benchmark windows; see ``decontaminate``."""
    spans = decontaminate.contaminated_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(spans)


def op6_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in reply order without quotes; see ``quotations``."""
    return quotations.link_quotations(_table(spark, sf_dir, "conversations"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; see ``quality``."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among the documents; see ``exact_dedup``."""
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; see ``pii``."""
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document; see ``sharding``."""
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents by compression; see ``language_id``."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of two to four words in all documents, by language; see ``collocations``."""
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes after any others, by language; see ``filter_audit``."""
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NOT_SPACE = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_GROUPS_SQL = f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_NOT_SPACE}') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, shingle FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id, any_value(same) AS n_same
    FROM reach JOIN (SELECT doc_id AS a, count(*) OVER (PARTITION BY CASE WHEN k IS NULL THEN doc_id::VARCHAR ELSE k END) AS same FROM documents LEFT JOIN (SELECT doc_id, 'k' || string_agg(shingle, chr(1) ORDER BY shingle) AS k FROM s GROUP BY doc_id) USING (doc_id)) USING (a)
    JOIN documents ON doc_id = a LEFT JOIN n USING (doc_id) GROUP BY doc_id"""

_HITS_SQL = f"""
    WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
    i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
    windows AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS words FROM (SELECT *, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
    found AS MATERIALIZED (
        SELECT doc_id, k, windows.n, item FROM (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS words FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)) JOIN windows USING (n, words)),
    hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""


_MARKS = r"^[ \t]*((?:>[ \t]?)+)"
_NORMAL = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"

_REPLIES_SQL = rf"""
    WITH RECURSIVE m AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM conversations),
    l AS MATERIALIZED (
        SELECT conv_id, turn, i, len(regexp_replace(regexp_extract(line, '{_MARKS}', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '{_MARKS}', '') AS says
        FROM (SELECT conv_id, turn, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM m)),
    own AS MATERIALIZED (SELECT conv_id, turn, regexp_replace(string_agg(says, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS content FROM l WHERE level = 0 GROUP BY ALL),
    said AS MATERIALIZED (
        SELECT DISTINCT conv_id, turn, {_NORMAL.format("part")} AS words
        FROM (SELECT conv_id, turn, unnest(list_concat([content], string_split_regex(content, '\n\s*\n'), string_split(content, chr(10)))) AS part FROM own)),
    q AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS block FROM l WHERE level > 0),
    quotes AS MATERIALIZED (
        SELECT DISTINCT * FROM (
            SELECT conv_id, turn, level, 0 AS part, {_NORMAL.format("string_agg(says, ' ' ORDER BY i)")} AS words FROM q GROUP BY conv_id, turn, block, level
            UNION ALL SELECT conv_id, turn, level, 1, {_NORMAL.format("says")} FROM q) WHERE words <> ''),
    links AS (SELECT c.conv_id, c.turn, c.level, c.part, c.words, max(s.turn) AS found FROM quotes c JOIN said s ON s.conv_id = c.conv_id AND s.words = c.words AND s.turn < c.turn GROUP BY ALL),
    best AS MATERIALIZED (SELECT conv_id, turn, arg_min(found, (level, part, -found)) AS parent, count(*) AS n_linked FROM links GROUP BY ALL),
    chain AS (SELECT conv_id, turn, parent AS root, 1 AS depth FROM best UNION ALL SELECT c.conv_id, c.turn, b.parent, c.depth + 1 FROM chain c JOIN best b ON b.conv_id = c.conv_id AND b.turn = c.root),
    ends AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM chain GROUP BY ALL),
    counts AS (SELECT conv_id, turn, count(*) FILTER (part = 0) AS n_quotes, max(level)::BIGINT AS max_level FROM quotes GROUP BY ALL)
    SELECT conv_id, turn, role, coalesce(content, '') AS content, coalesce(n_quotes, 0) AS n_quotes, coalesce(max_level, 0) AS max_level, coalesce(n_linked, 0) AS n_linked,
           parent AS reply_to, coalesce(root, turn) AS root_turn, coalesce(depth, 0)::BIGINT AS depth
    FROM m LEFT JOIN own USING (conv_id, turn) LEFT JOIN counts USING (conv_id, turn) LEFT JOIN best USING (conv_id, turn) LEFT JOIN ends USING (conv_id, turn)"""


_MIX_SQL = f"""
    WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_NOT_SPACE}'))::BIGINT AS size,
                                   row_number() OVER (PARTITION BY doc_id, source, size ORDER BY doc_id) - 1 AS number, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || number), 1, 15))::BIGINT AS u FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
    w AS (SELECT *, [5, 2, 1][place % 3 + 1] AS weight FROM s),
    r AS (SELECT *, 3 * source_size / weight AS ratio FROM w),
    k AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                 sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, row_number() OVER (ORDER BY ratio, place) AS rank FROM r),
    stop AS (SELECT min(rank) AS rank, arg_min(rest, rank) AS rest, arg_min(open, rank) AS open FROM k WHERE rest / open <= ratio),
    t AS MATERIALIZED (SELECT k.source, k.source_size, least({mixing.MAX_SHARDS}, (k.n + {mixing.SHARD_DOCS - 1}) // {mixing.SHARD_DOCS}) AS shards, k.place, CASE WHEN stop.rank IS NULL OR k.rank < stop.rank THEN (3 * k.source_size)::DOUBLE ELSE stop.rest::DOUBLE * k.weight / stop.open END AS target FROM k, stop),
    b AS (SELECT greatest(1, least(floor(sum(target) / {mixing.BLOCKS}), min(floor(target / {mixing.TARGET_BLOCKS})) FILTER (target > 0), min(source_size // shards // {mixing.SHARD_BLOCKS}) FILTER (target > 0)))::BIGINT AS block, sum(target) AS total FROM t),
    seats AS (SELECT source, count(*) AS quota FROM (
        SELECT source, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, place) AS i, block, total
        FROM (SELECT *, unnest(range(0, (target / block * 1.01)::BIGINT + 10)) AS seat FROM t, b WHERE target > 0)) WHERE i <= round_even(total / block, 0) GROUP BY source),
    e AS (SELECT d.*, t.source_size, t.target, u % t.shards AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    h AS (SELECT source, shard, sum(size)::BIGINT AS shard_size FROM e GROUP BY ALL),
    dealt AS (SELECT source, shard, count(*) AS blocks FROM (
        SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * seat + 1) DESC, shard) AS i
        FROM (SELECT h.*, coalesce(quota, 0) AS quota, unnest(range(0, (3 * shard_size + block - 1) // block)) AS seat FROM b, h LEFT JOIN seats ON h.source IS NOT DISTINCT FROM seats.source)) WHERE i <= quota GROUP BY ALL),
    g AS (SELECT e.*, shard_size, least(coalesce(blocks, 0) * block, 3 * shard_size) AS words, sum(size) OVER (PARTITION BY e.source, e.shard ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) AS until, coalesce(quota, 0) AS quota
          FROM b, e JOIN h ON e.source IS NOT DISTINCT FROM h.source AND e.shard = h.shard LEFT JOIN dealt ON e.source IS NOT DISTINCT FROM dealt.source AND e.shard = dealt.shard LEFT JOIN seats ON e.source IS NOT DISTINCT FROM seats.source)
    SELECT doc_id, size, source_size, target, quota AS quota_blocks,
           (CASE WHEN shard_size > 0 THEN words // shard_size * size + greatest(0, least(size, words % shard_size - (until - size))) ELSE 0 END)::BIGINT AS taken FROM g"""


def _secrets_sql() -> str:
    """Secrets in SQL: places are sums of the matches and of the pieces between them; word bounds stand for look-around."""
    found, ok = [], []
    for number, kind in enumerate(secrets.KINDS):
        pattern = kind.pattern.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b").replace("(?<![A-Za-z0-9+/_-])", "").replace("'", "''")
        found.append(f"SELECT doc_id, {number} AS kind, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {kind.group}) AS parts, string_split_regex(t, '{pattern}') AS gaps FROM d")
        ok.append(f"(kind = {number} AND length(part) >= {kind.least}" + "".join(f" AND regexp_matches(hit, '{h}')" for h in kind.has) + ")")
    names = ", ".join(f"'{k.name}'" for k in secrets.KINDS)
    roles = ", ".join(f"'{k.role}'" for k in secrets.KINDS)
    listed = f"string_agg([{names}][kind + 1] || ':' || lo || ':' || hi, ',' ORDER BY lo, kind)"
    n = len(secrets.BASE)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    f AS ({" UNION ALL ".join(found)}),
    e AS (SELECT doc_id, kind, i, hits[i] AS hit, parts[i] AS part, gaps[i] AS gap FROM (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM f)),
    s AS MATERIALIZED (SELECT doc_id, kind, hi - length(hit) AS lo, hi, [{roles}][kind + 1] AS role, kind < {n} AS base FROM (
        SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS hi FROM e) WHERE {" OR ".join(ok)}),
    j AS (SELECT w.doc_id, w.kind, w.lo, w.hi, bool_or(o.base AND o.lo < w.hi AND w.lo < o.hi) AS inside,
                 bool_or(o.base AND o.role <> w.role AND (o.hi <= w.lo OR w.hi <= o.lo)) AS strong, count(DISTINCT o.role) FILTER (o.role <> w.role AND (o.hi <= w.lo OR w.hi <= o.lo)) AS roles
          FROM s w JOIN s o ON o.doc_id = w.doc_id AND o.lo <= w.hi + {secrets.SCOPE} AND w.lo <= o.hi + {secrets.SCOPE} WHERE NOT w.base GROUP BY w.doc_id, w.kind, w.lo, w.hi),
    a AS (SELECT doc_id, kind, lo, hi FROM s WHERE base UNION ALL SELECT doc_id, kind, lo, hi FROM j WHERE NOT inside AND (strong OR roles >= 2)),
    g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(secrets.BASE))}, {listed} FILTER (kind < {n}) AS base, {listed} AS every FROM a GROUP BY doc_id)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


_PHRASES_SQL = f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
    f AS MATERIALIZED (
        SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
        GROUP BY ALL HAVING count(*) >= {collocations.MIN_COUNT}),
    c AS (SELECT *, string_split(phrase, ' ') AS x FROM f WHERE k > 1),
    u AS (SELECT *, unnest(range(1, k)) AS k1 FROM c),
    s AS (SELECT u.lang, u.phrase, u.a, k1, b.a AS l, e.a AS r, 2000000::HUGEINT * u.a // (b.a::HUGEINT + e.a) AS score
          FROM u JOIN f b ON b.lang = u.lang AND b.phrase = array_to_string(x[1:k1], ' ') JOIN f e ON e.lang = u.lang AND e.phrase = array_to_string(x[k1 + 1:u.k], ' ')),
    g AS (SELECT lang, phrase, any_value(a) AS a, arg_min(l, (score, k1)) AS l, arg_min(r, (score, k1)) AS r, min(score)::BIGINT AS score FROM s GROUP BY lang, phrase),
    o AS (SELECT lang, a AS longer, array_to_string(x[i:j], ' ') AS phrase FROM (SELECT *, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM c)) WHERE j - i + 1 < k),
    h AS (SELECT DISTINCT g.lang, g.phrase FROM g JOIN o ON o.lang = g.lang AND o.phrase = g.phrase AND 100::HUGEINT * longer >= {collocations.COVER_PERCENT}::HUGEINT * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM g ANTI JOIN h USING (lang, phrase) JOIN n USING (lang) QUALIFY rank <= {collocations.TOP}"""


_AUDIT_SQL = f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_NOT_SPACE}') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    c AS MATERIALIZED (
        SELECT part, (len(w) < {filter_audit.MIN_WORDS})::INTEGER + 2 * (100 * len(list_distinct(w)) < {filter_audit.MIN_DISTINCT_PERCENT} * len(w))::INTEGER
                     + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {filter_audit.MAX_CAPITAL_PERCENT} * length(t))::INTEGER + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER + 16 * coalesce(d.doc_id > first, false)::INTEGER AS mask,
               coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s AS (SELECT *, 1 << (ascii(filter_order[step]) - 65) AS next, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INTEGER AS applied FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM p)),
    r AS (SELECT part, filter_order, step::INTEGER AS step, next,
                 coalesce(sum(n) FILTER (mask & (applied | next) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & applied = 0 AND mask & next <> 0), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (mask & applied <> 0 AND mask & next <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = next), 0)::BIGINT AS unique_fails,
                 coalesce(sum(n) FILTER (mask & applied = 0 AND mask & next <> 0 AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (mask & applied = 0 AND mask & next <> 0 AND toxic), 0)::BIGINT AS toxic_lost
          FROM c, s GROUP BY ALL)
    SELECT * EXCLUDE next, sum(removed) OVER (PARTITION BY part, next)::BIGINT AS shapley FROM r"""


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_mixing": op3_mixing,
    "op4_secrets": op4_secrets,
    "op5_decontaminate": op5_decontaminate,
    "op6_quotations": op6_quotations,
    "op7_quality": op7_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_pii": op9_pii,
    "op10_sharding": op10_sharding,
    "op11_language_id": op11_language_id,
    "op12_collocations": op12_collocations,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {
    "op2_ngram_jaccard": _GROUPS_SQL,
    "op3_mixing": _MIX_SQL,
    "op4_secrets": _secrets_sql(),
    "op5_decontaminate": _HITS_SQL,
    "op6_quotations": _REPLIES_SQL,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op12_collocations": _PHRASES_SQL,
    "op13_filter_audit": _AUDIT_SQL,
    "op10_sharding": f"""
        WITH sized AS (
            SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
                   lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits
            FROM documents),
        sums AS (
            SELECT d, substr(bits, 1, d) AS prefix, count(*) AS n, sum(n_bytes)::BIGINT AS bytes
            FROM sized, range(61) AS r(d) GROUP BY ALL)
        SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN 'root' ELSE prefix END AS shard, d::INTEGER AS depth,
               n AS shard_docs, bytes AS shard_bytes, bytes <= {sharding.SHARD_BYTES} AS fits
        FROM sized JOIN sums ON prefix = substr(bits, 1, d::INTEGER)
        WHERE bytes <= {sharding.SHARD_BYTES} OR n = 1 OR d = 60
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d) = 1""",
}
