"""Queries of trimming, names, unions and reports, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hosts import is_description
from ..operators import curate
from ..operators.resolve_hosts import looks_like_a_taxon
from ..session import spread
from .queries import _KEYED, _table, query
from .views import duck, view

_RANK = "CASE WHEN k = '' OR regexp_matches(k, '^(?:uncultured|unidentified|unclassified|environmental|microsporidian?|fungal|eukaryot[a-z0-9_]*|unnamed|unknown|undescribed|mutated)\\b') THEN 2 WHEN t[1] = 'sp' THEN 1 WHEN len(t) >= 2 AND t[2] <> 'sp' AND NOT regexp_full_match(t[2], '[0-9]+') THEN 0 ELSE 1 END"
_LINES = "SELECT l_orderkey AS target, sum(CAST(l_quantity AS BIGINT)) AS len, max(l_suppkey * 3) AS cov FROM lineitem WHERE l_linestatus = 'F' AND l_tax <= 0.05 GROUP BY l_orderkey"


def _trimmed(spark, sf_dir):
    """Each order with its significant hits, if any, and what becomes of it."""
    hits = _table(spark, sf_dir, "lineitem").where((F.col("l_linestatus") == "F") & (F.col("l_tax") <= 0.05))
    h = hits.groupBy(F.col("l_orderkey").alias("target")).agg(F.sum(F.col("l_quantity").cast("long")).alias("len"), F.max(F.col("l_suppkey") * 3).alias("cov"))
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target"), "o_orderpriority").join(h, "target", "left")
    status, reason = curate.trim_status(F.col("len").isNotNull(), F.col("len"), F.col("cov"), 40, 20)
    return o.select("target", "o_orderpriority", "cov", status.alias("status"), reason.alias("reason"))


_TRIMMED = f"""(SELECT o_orderkey AS target, o_orderpriority, cov, CASE WHEN len IS NULL THEN 'no significant CM hit' WHEN len < 40 THEN 'trimmed length ' || len || ' < 40' WHEN cov < 20 THEN 'model coverage ' || cov || ' < 20' ELSE '' END AS reason FROM orders LEFT JOIN ({_LINES}) h ON target = o_orderkey)"""


@query(f"SELECT target, CASE WHEN reason = '' THEN 'kept' ELSE 'dropped' END AS status, reason FROM {_TRIMMED}")
def trim_cascade(spark, sf_dir):
    return _trimmed(spark, sf_dir).select("target", "status", "reason")


@query(f"SELECT o_orderpriority AS part, min(cov) AS least, list_sort(list(cov))[len(list(cov)) // 2 + 1] AS median, max(cov) AS most FROM {_TRIMMED} WHERE reason = '' GROUP BY o_orderpriority")
def trim_statistics(spark, sf_dir):
    kept = _trimmed(spark, sf_dir).where("status = 'kept'").withColumnRenamed("o_orderpriority", "part")
    return curate.upper_median(kept, "part", "cov")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size * 40 AS BIGINT) ELSE length(p_name) END AS metric, CASE WHEN p_partkey % 3 = 0 THEN p_size * 40 ELSE length(p_name) END >= 30 OR p_partkey % 7 = 0 AS stays FROM part")
def length_floor(spark, sf_dir):
    """The length of a member by its tag or its sequence; centroids stay whatever it is."""
    header = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(">a [cm_from=1] [cm_cov="), (F.col("p_size") * 40).cast("string"), F.lit("]"))).otherwise(F.lit(">a cm_cov="))
    n = curate.tagged_length(header, F.col("p_name"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), n.alias("metric"), ((n >= 30) | (F.col("p_partkey") % 7 == 0)).alias("stays"))


_ODD = "(SELECT p_partkey AS id, CASE p_partkey % 11 WHEN 0 THEN 'Species ' || chr(160) || ' name' WHEN 1 THEN '  ' WHEN 2 THEN 'The ' || p_name WHEN 3 THEN upper(substr(p_name, 1, 1)) || split_part(substr(p_name, 2), ' ', 1) WHEN 4 THEN 'Abc' WHEN 5 THEN 'Unidentified ' || p_name WHEN 6 THEN ' Daphnia magna ' WHEN 7 THEN CAST(p_size AS STRING) || ' species of ' || p_name WHEN 8 THEN 'THE ' || p_name WHEN 9 THEN 'Thea ' || p_name ELSE p_name END AS nm FROM {part})"


@query(f"SELECT count(*) FILTER (k = 'species name') AS headers, count(*) FILTER (k = '') AS blank, count(*) FILTER (k NOT IN ('', 'species name')) AS stays FROM (SELECT lower(trim(regexp_replace(replace(nm, chr(160), ' '), '\\s+', ' ', 'g'))) AS k FROM {_ODD.replace('{part}', 'part')})")
def dropped_rows(spark, sf_dir):
    """Header rows that stand among the data, and rows without a name."""
    k = spark.sql(f"SELECT nm FROM {_ODD} q", part=_table(spark, sf_dir, "part")).select(F.lower(tx.clean(F.col("nm"))).alias("k"))
    return k.agg(F.count_if(F.col("k") == "species name").alias("headers"), F.count_if(F.col("k") == "").alias("blank"), F.count_if(~F.col("k").isin("", "species name")).alias("stays"))


#: What a first word must not be, spelt out for the SQL.
_NO_NAME = ("a", "an", "the", "unnamed", "unidentified", "undescribed", "gregarine", "form", "parasitic")
_FIRST = "regexp_extract(lower(nm), '^([a-z0-9_]*)', 1)"


@query(
    f"""SELECT id, nm <> '' AND (nm[1] = lower(nm[1]) OR {_FIRST} IN {_NO_NAME}) AS description,
  trim(nm)[1] BETWEEN 'A' AND 'Z' AND length(trim(nm)) >= 4 AND regexp_full_match(trim(nm)[2:], '[a-z-]+(\\s+[a-z-]+)?') AS taxon, NOT regexp_matches(nm, '^[A-Z][a-z]') AS odd FROM {_ODD.replace('{part}', 'part')}"""
)
def name_tests(spark, sf_dir):
    x = spark.sql(f"SELECT id, nm FROM {_ODD} q", part=_table(spark, sf_dir, "part"))
    c = F.col("nm")
    return x.select("id", is_description(c).alias("description"), looks_like_a_taxon(c).alias("taxon"), (~c.rlike("^[A-Z][a-z]")).alias("odd"))


@query("SELECT c.country, c.n, e.extant, CASE WHEN e.extant > 0 THEN round(1000.0 * c.n / e.extant, 3) END AS rate, e.extant IS NULL AS missing FROM (SELECT s_nationkey AS country, count(*) AS n FROM supplier GROUP BY 1) c LEFT JOIN (SELECT c_nationkey + 3 AS country, count(*) AS extant FROM customer GROUP BY 1) e ON c.country = e.country")
def rates(spark, sf_dir):
    """Counts for each thousand of a reference; what the reference lacks is reported."""
    c = _table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("country")).agg(F.count("*").alias("n"))
    e = _table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") + 3).alias("country")).agg(F.count("*").alias("extant"))
    return c.join(e, "country", "left").select("country", "n", "extant", F.when(F.col("extant") > 0, F.round(1000.0 * F.col("n") / F.col("extant"), 3)).alias("rate"), F.col("extant").isNull().alias("missing"))


#: Names as rows spell them: some in capitals, some with doubled spaces.
_SPELT = "CASE id % 7 WHEN 0 THEN upper(nm) WHEN 1 THEN replace(nm, ' ', '  ') ELSE nm END"


@query(
    f"""WITH n AS (SELECT id % 300 AS cluster, id, trim(regexp_replace({_SPELT}, '\\s+', ' ', 'g')) AS nm, {_RANK} AS r FROM {_KEYED}), d AS (SELECT cluster, lower(nm) AS low, min(r) AS r, count(*) AS n, min(id) AS f, arg_min(nm, id) AS nm FROM n GROUP BY cluster, lower(nm))
  SELECT cluster, nm, n_names FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY r, len(string_split(nm, ' ')) > 2, length(nm), -n, f) AS k, count(*) OVER (PARTITION BY cluster) AS n_names FROM d) WHERE k = 1"""
)
def species_names(spark, sf_dir):
    n = view(spark, sf_dir, "names").select((F.col("id") % 300).alias("cluster"), "id", F.expr(_SPELT).alias("nm"), tx.name_rank(tx.name_key(F.col("nm"))).alias("r"))
    return curate.pick_name(n, "cluster", "nm", "r", "id")


_UNINFORMATIVE = "'^(uncultured|unidentified|unclassified|environmental|microsporidian?|fungal|eukaryot[a-z0-9_]*|unnamed|unknown|undescribed|mutated)\\b'"


@query(
    f"""WITH n AS (SELECT id % 1300 AS cluster, id, nm FROM {duck('names')}), g AS (SELECT cluster, upper(nm[1]) || lower(string_split(nm, ' ')[1][2:]) AS genus, id FROM n WHERE NOT regexp_matches(lower(nm), {_UNINFORMATIVE})),
  d AS (SELECT cluster, genus, count(*) AS votes, min(id) AS f FROM g GROUP BY 1, 2), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY votes DESC, f) AS k FROM d) WHERE k = 1)
  SELECT c.cluster, coalesce(genus, '') AS genus, coalesce(votes, 0) AS votes, coalesce(genus, 'Microsporidia') || ' sp. MSP-C' || CASE WHEN c.cluster < 10000 THEN printf('%04d', c.cluster) ELSE CAST(c.cluster AS VARCHAR) END AS label FROM (SELECT DISTINCT cluster FROM n) c LEFT JOIN w ON c.cluster = w.cluster"""
)
def provisional_labels(spark, sf_dir):
    """The commonest genus of each cluster, and the cluster's label by it; a cluster without one has a label too."""
    n = view(spark, sf_dir, "names").select((F.col("id") % 1300).alias("cluster"), "id", "nm")
    genus = F.when(~F.lower("nm").rlike(tx.UNINFORMATIVE), F.initcap(F.split("nm", " ")[0]))
    won = curate.majority(n.withColumn("genus", genus), "cluster", "genus", "id")
    every = n.select("cluster").distinct().join(won, "cluster", "left")
    return every.select("cluster", F.coalesce("genus", F.lit("")).alias("genus"), F.coalesce("votes", F.lit(0)).alias("votes"), curate.provisional_label(F.col("genus"), "MSP", F.col("cluster")).alias("label"))


@query(f"SELECT host, string_agg(DISTINCT phylum, '; ' ORDER BY phylum) AS vals, string_agg(source, '+' ORDER BY ord) AS sources FROM {duck('sources')} WHERE phylum <> '' GROUP BY host")
def united_sources(spark, sf_dir):
    return curate.united(view(spark, sf_dir, "sources"), "host", "source", "ord", "phylum")


@query(f"SELECT kind, count(*) FILTER (y IS NULL) AS missing, count(*) AS total, round(100.0 * count(*) FILTER (y IS NULL) / count(*), 2) AS percent, 10 * count(*) FILTER (y IS NULL) > count(*) AS alarm FROM (SELECT id % 6 AS kind, nullif(regexp_extract(cell, '\\b(1[89][0-9]{{2}}|20[0-9]{{2}})\\b', 1), '') AS y FROM {duck('dates')}) GROUP BY kind")
def missing_dates(spark, sf_dir):
    """Entries without a first year by kind; over a tenth is an alarm."""
    y = F.nullif(F.regexp_extract("cell", r"\b(1[89][0-9]{2}|20[0-9]{2})\b", 1), F.lit(""))
    g = view(spark, sf_dir, "dates").groupBy((F.col("id") % 6).alias("kind")).agg(F.count_if(y.isNull()).alias("missing"), F.count("*").alias("total"))
    return g.select("kind", "missing", "total", F.round(100.0 * F.col("missing") / F.col("total"), 2).alias("percent"), (10 * F.col("missing") > F.col("total")).alias("alarm"))


@query("SELECT parent, CASE WHEN n < 80 THEN 'other ' || parent ELSE grp END AS grp, CAST(sum(n) AS BIGINT) AS n FROM (SELECT substr(p_type, 1, 5) AS parent, p_type AS grp, count(*) * 10 AS n FROM part GROUP BY 1, 2) GROUP BY 1, 2")
def pooled_groups(spark, sf_dir):
    n = _table(spark, sf_dir, "part").groupBy(F.substring("p_type", 1, 5).alias("parent"), F.col("p_type").alias("grp")).agg((F.count("*") * 10).alias("n"))
    return curate.pooled(n, "grp", "parent", "n", 80)


@query("SELECT species, count(*) AS clusters, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS sd, round(min(m), 4) AS least, round(max(m), 4) AS most, count(*) FILTER (m < 6000) AS n_low FROM (SELECT l_partkey AS species, l_suppkey AS cluster, avg(l_extendedprice * 0.196349540849) AS m FROM lineitem GROUP BY 1, 2) GROUP BY species")
def species_averages(spark, sf_dir):
    p = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("species"), F.col("l_suppkey").alias("cluster"), (F.col("l_extendedprice") * 0.196349540849).alias("v"))
    return curate.averages(p, "cluster", "species", "v", 6000)


_IDENT = "80 + l_quantity * 0.4 + l_tax"


@query(f"SELECT CASE WHEN v < 90 THEN '<90' WHEN v < 95 THEN '90-95' WHEN v < 98 THEN '95-98' WHEN v < 99 THEN '98-99' ELSE '>=99' END AS class, count(*) AS n, round(median(v), 6) AS median FROM (SELECT CAST({_IDENT} AS DOUBLE) AS v FROM lineitem) GROUP BY 1")
def identity_classes(spark, sf_dir):
    v = _table(spark, sf_dir, "lineitem").select(F.expr(f"CAST({_IDENT} AS DOUBLE)").alias("v"))
    return v.groupBy(curate.identity_class(F.col("v")).alias("class")).agg(F.count("*").alias("n"), F.round(F.median("v"), 6).alias("median"))


@query("SELECT names, count(*) AS n FROM (SELECT l_orderkey, string_agg(DISTINCT 'n' || l_suppkey % 6, '|' ORDER BY 'n' || l_suppkey % 6) AS names FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 6) > 1) GROUP BY names")
def synonym_candidates(spark, sf_dir):
    """How often each set of names stands for one thing."""
    s = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("n"), (F.col("l_suppkey") % 6).cast("string")))).alias("s")).where(F.size("s") > 1)
    return s.groupBy(F.array_join("s", "|").alias("names")).agg(F.count("*").alias("n"))


@query("SELECT species, cluster, n, n_clusters FROM (SELECT l_partkey AS species, l_suppkey AS cluster, count(*) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, min(l_orderkey), l_suppkey) AS k, count(*) OVER (PARTITION BY l_partkey) AS n_clusters FROM lineitem GROUP BY 1, 2) WHERE k = 1 AND n_clusters > 1")
def largest_clusters(spark, sf_dir):
    """Species that are split over clusters, with the largest one, of equals the first seen."""
    n = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("species"), F.col("l_suppkey").alias("cluster")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("f"))
    g = n.groupBy("species").agg(F.min_by("cluster", F.struct(-F.col("n"), "f", "cluster")).alias("cluster"), F.max("n").alias("n"), F.count("*").alias("n_clusters"))
    return g.where("n_clusters > 1")


@query(f"SELECT id, len(y) AS n_years FROM (SELECT id, list_distinct(list_filter(regexp_extract_all(cell, '[0-9]+'), lambda x: length(x) = 4 AND CAST(x AS INTEGER) BETWEEN 1600 AND 2026)) AS y FROM {duck('dates')}) WHERE len(y) > 1")
def several_years(spark, sf_dir):
    numbers = F.regexp_extract_all(F.col("cell"), F.lit("[0-9]+"), F.lit(0))
    y = F.array_distinct(F.filter(numbers, lambda x: (F.length(x) == 4) & x.try_cast("int").between(1600, 2026)))
    return view(spark, sf_dir, "dates").select("id", F.size(y).cast("long").alias("n_years")).where("n_years > 1")


@query(
    """WITH p AS (SELECT p_partkey AS id, string_split(p_name, ' ') || CASE WHEN p_partkey % 4 = 0 THEN [upper(p_name)] ELSE [] END AS a, string_split(upper(p_type) || ' ' || upper(split_part(p_name, ' ', 1)) || ' Cc dd', ' ') || ['cc', 'Cc  dd', 'cc dd', p_name] AS b FROM part),
  v AS (SELECT id, 0 AS side, i, a[i] AS v FROM p, range(1, len(a) + 1) t(i) UNION ALL SELECT id, 1, i, b[i] FROM p, range(1, len(b) + 1) t(i) WHERE NOT list_contains(list_transform(a, lambda x: lower(x)), lower(b[i]))),
  d AS (SELECT id, arg_min(v, (side, i)) AS v, min((side, i)) AS o FROM (SELECT id, side, i, regexp_replace(v, '\\s+', ' ', 'g') AS v FROM v) GROUP BY id, lower(v))
  SELECT d.id, string_agg(v, '|' ORDER BY o) AS merged, any_value(n) AS n_new FROM d JOIN (SELECT id, count(*) FILTER (side = 1) AS n FROM v GROUP BY id) c ON d.id = c.id GROUP BY d.id"""
)
def merged_lists(spark, sf_dir):
    """Two lists that repeat values in other cases and with other spaces."""
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    a = F.concat(F.split("p_name", " "), F.when(F.col("p_partkey") % 4 == 0, F.array(F.upper("p_name"))).otherwise(F.array().cast("array<string>")))
    b = F.concat(F.split(F.concat_ws(" ", F.upper("p_type"), F.upper(first), F.lit("Cc dd")), " "), F.array(F.lit("cc"), F.lit("Cc  dd"), F.lit("cc dd"), F.col("p_name")))
    both, n = curate.merged(a, b)
    return spread(_table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("id"), F.array_join(both, "|").alias("merged"), n.alias("n_new"))


@query("SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) AS either FROM (SELECT coalesce(x.k, y.k) AS k, x.k IS NOT NULL AS a, y.k IS NOT NULL AS b FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') x FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') y ON x.k = y.k)")
def key_sets(spark, sf_dir):
    """Sizes of what two sets of keys share and don't: one grouping, no join."""
    g = _table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'O')").groupBy("o_custkey").agg(F.max(F.col("o_orderstatus") == "F").alias("a"), F.max(F.col("o_orderstatus") == "O").alias("b"))
    return g.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"), F.count("*").alias("either"))


@query("SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def common_to_all(spark, sf_dir):
    """Keys that every panel has."""
    o = _table(spark, sf_dir, "orders")
    panels = o.agg(F.countDistinct("o_orderpriority").alias("p"))
    return o.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("d")).join(F.broadcast(panels), F.col("d") == F.col("p")).select("k", "n")


_BOTH = """(SELECT p_partkey, split_part(p_name, ' ', 1) AS a, CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) END AS b,
  CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN p_name || ' (L., 1758)' WHEN 2 THEN upper(p_name) || '.' WHEN 3 THEN p_type || ' ' || p_name ELSE split_part(p_name, ' ', 1) || '-' || split_part(p_name, ' ', 2) END AS got, p_name FROM {part})"""


@query(
    f"""SELECT p_partkey AS id, CASE WHEN abs(length(a) - length(b)) > 2 THEN 99 ELSE levenshtein(a, b) END AS edits,
  got <> '' AND list_filter(regexp_split_to_array(regexp_replace(lower(got), '[^a-z ]', '', 'g'), ' '), lambda x: x <> '')[1:2] <> list_filter(regexp_split_to_array(lower(p_name), ' '), lambda x: x <> '')[1:2] AS changed FROM {_BOTH.replace('{part}', 'part')}"""
)
def name_edits(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM {_BOTH} q", part=_table(spark, sf_dir, "part"))
    return rows.select(F.col("p_partkey").alias("id"), curate.edits(F.col("a"), F.col("b")).alias("edits"), curate.name_changed(F.col("p_name"), F.col("got")).alias("changed"))


@query("SELECT p_partkey AS id, CASE WHEN lower(p_type) IN ('medium', 'standard') THEN 'small' WHEN lower(p_brand) IN ('brand#4', 'brand#2') THEN 'first' WHEN lower(p_type) = 'large' THEN 'large' ELSE 'Other / unplaced' END AS grp FROM part")
def host_groups(spark, sf_dir):
    rules = [("small", "p_type", ["Medium", "STANDARD"]), ("first", "p_brand", ["BRAND#4", "brand#2"]), ("large", "p_type", ["large"])]
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), curate.first_rule(rules, "Other / unplaced", "Unresolved").alias("grp"))


@query("SELECT c_custkey AS id, n_name AS country, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE trim(c_mktsegment) || ': ' || c_custkey END AS region FROM customer JOIN nation ON c_nationkey = n_nationkey")
def localities(spark, sf_dir):
    """Country and region of a locality such as "France: Lyon: 5"."""
    j = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cell = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.col("n_name"))).otherwise(F.concat(F.col("n_name"), F.lit(" :  "), F.col("c_mktsegment"), F.lit(": "), F.col("c_custkey").cast("string")))
    country, region = curate.place(cell)
    return j.select(F.col("c_custkey").alias("id"), country.alias("country"), region.alias("region"))


@query("SELECT cell, pos, l_orderkey AS ord FROM (SELECT l_suppkey AS cell, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS pos FROM lineitem) WHERE pos <= 10")
def stack_positions(spark, sf_dir):
    """The place of each symbol of a tip, ten at most; the window keeps no more than ten rows of a key."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    x = _table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(w)).where("pos <= 10")
    return x.select(F.col("l_suppkey").alias("cell"), "pos", F.col("l_orderkey").alias("ord"))
