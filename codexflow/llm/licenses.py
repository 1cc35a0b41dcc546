"""License scans: TF-IDF cosine to templates, then inheritance by directory.

Units of a file are each of its lines, overlapping groups of lines, of which the
first is its head, and its whole text. A unit's vector has a weight for each
term (its number times its inverse document frequency among the templates); the
cosine to each template's sparse vector decides. A file whose whole text is like
a template, or whose head is like a licence's text, speaks for its directory; a
file without a notice of its own takes the licence of its nearest ancestor
directory that has one.

Only DataFrame functions are used. Of each template, the heaviest terms are its
anchors, so many that the others alone can't reach the bound: units without any
anchor are left out before anything is counted, and nothing else is.

Of a file's findings the one that makes it a licence file counts most, then the
highest cosine.

Nulls and edges: a null text is the empty text, a null path has no directory
and inherits nothing. Rows that share a path are scored each on its own. Ties
go to the first licence by name, then the first path. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.llm import common
from codexflow.llm.license_texts import HEADERS, NOTICES, TEXTS, TITLES

#: Licence, text, and whether a head like it makes the file a licence file.
Template = tuple[str, str, bool]
#: Short notices by licence; and all templates.
TEMPLATES: dict[str, str] = dict(NOTICES)
ALL: list[Template] = [(*x, False) for x in NOTICES + TITLES + HEADERS] + [(*x, True) for x in TEXTS]
#: Words without weight (fixed values).
STOP = frozenset(
    """a all also an and any are as at be been but by can did do does each for form forms from had has have he her his how i if in into is it its may more most no nor not
    of on one only or other our out she so some such than that the their them then there these they this those to under up us use used v was we were what when where
    which who will with work would you your""".split()
)
#: Least cosine; lines in a group, and how far apart groups start.
LEAST, GROUP_LINES, GROUP_STEP = 0.6, 12, 6


def listed(templates: dict[str, str] | list[Template]) -> list[Template]:
    return [(k, v, False) for k, v in templates.items()] if isinstance(templates, dict) else list(templates)


def terms_of(text: str) -> list[str]:
    """Lower-case runs of ASCII letters and digits, without stop words."""
    return [t for t in re.findall("[a-z0-9]+", text.lower()) if t not in STOP]


def _weights(templates: list[Template]) -> tuple[list[tuple[int, str, float]], dict[str, float], float]:
    """(place, term, unit weight) of every template, the terms' idf, and that of unseen terms."""
    counts = [Counter(terms_of(text)) for _, text, _ in templates]
    n, df = len(counts), Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    rows = []
    for i, c in enumerate(counts):
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        rows += [(i, t, k * idf[t] / norm) for t, k in c.items()]
    return rows, idf, math.log(1 + n) + 1


def template_weights(templates: dict[str, str] | list[Template]) -> tuple[list[tuple[str, str, float]], dict[str, float], float]:
    """The same with the licence for the template's place."""
    names = [name for name, _, _ in listed(templates)]
    rows, idf, unseen = _weights(listed(templates))
    return [(names[i], t, w) for i, t, w in rows], idf, unseen


def anchors(templates: list[Template], least: float) -> list[str]:
    """Terms of which a unit must have one to reach ``least`` with any template.

    A cosine is at most the norm of the template's terms that the unit has.
    """
    by: dict[int, list[tuple[float, str]]] = {}
    for i, t, w in _weights(templates)[0]:
        by.setdefault(i, []).append((w, t))
    out = set()
    for terms in by.values():
        rest = 1.0
        for w, t in sorted(terms, reverse=True):
            if rest < least**2 * (1 - 1e-9):
                break
            out.add(t)
            rest -= w * w
    return sorted(out)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*sorted(STOP)))


def score_words(units: DataFrame, templates: list[Template], least: float = 0.0) -> DataFrame:
    """Cosines of units of ``words``: the keys (all other columns), ``template`` (its place) and ``score``.

    All that reach ``least`` are there, lower ones not always.
    """
    spark = units.sparkSession
    rows, idf, unseen = _weights(templates)
    keys = [c for c in units.columns if c != "words"]
    if least > 0:
        # The cosine is at most that of the unit to its own template terms: long prose
        # around a few of them can't reach the bound and is left out before any shuffle.
        # Of n terms, d of them distinct, the squares of their numbers add up to at most (n - d + 1)**2 + d - 1.
        units = units.filter(F.exists("words", lambda t: t.isin(*anchors(templates, least))))
        units = units.withColumn("_known", F.filter("words", lambda t: t.isin(*sorted(idf)))).withColumn("_d", F.size(F.array_distinct("_known")))
        squares = F.pow(F.size("_known") - F.col("_d") + 1, F.lit(2)) + F.col("_d") - 1
        others = F.size(F.array_distinct("words")) - F.col("_d")
        units = units.filter(others * (unseen**2) <= (1 / least**2 - 1) * squares * max(idf.values()) ** 2 * (1 + 1e-9)).drop("_known", "_d")
    terms = units.select(*keys, F.explode("words").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    # The templates' terms: as many as the templates have.
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    weight = F.broadcast(spark.createDataFrame(rows, "template int, term string, weight double"))
    terms = terms.join(known, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norms = terms.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "w"))).alias("seen"))
    hits = norms.select(*keys, "norm", F.explode("seen").alias("s")).select(*keys, "norm", "s.term", "s.w").join(weight, "term")
    return hits.groupBy(*keys, "template").agg((F.sum(F.col("w") * F.col("weight")) / F.first("norm")).alias("score"))


def _named(spark: SparkSession, templates: list[Template]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(i, name, whole) for i, (name, _, whole) in enumerate(templates)], "template int, license string, whole boolean"))


def score_units(units: DataFrame, templates: dict[str, str] | list[Template], least: float = 0.0) -> DataFrame:
    """Best cosines of ``unit`` texts by licence: the keys (all columns but ``unit``), ``license`` and ``score``."""
    keys = [c for c in units.columns if c != "unit"]
    found = score_words(units.select(*keys, _words(F.col("unit")).alias("words")), listed(templates), least)
    return found.join(_named(units.sparkSession, listed(templates)), "template").groupBy(*keys, "license").agg(F.max("score").alias("score"))


def scan_files(files: DataFrame, templates: dict[str, str] | list[Template] = ALL, least: float = LEAST) -> DataFrame:
    """Own notices of ``(uid, path, text)`` rows that have any: ``uid``, ``license``, ``score``, ``is_file``."""
    templates, bound = listed(templates), least - 1e-6
    some = files.select("uid", common.text_or_empty().alias("text"))
    some = some.filter(F.exists(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: t.isin(*anchors(templates, bound))))
    some = some.select("uid", F.transform(F.split("text", "\n"), _words).alias("lines"))
    starts = F.sequence(F.lit(0), F.ceil(F.greatest(F.size("lines") - GROUP_LINES, F.lit(0)) / GROUP_STEP).cast("int"))
    parts = F.concat(
        F.transform("lines", lambda x: F.struct(F.lit("line").alias("kind"), x.alias("words"))),
        F.transform(starts, lambda i: F.struct(F.when(i == 0, "head").otherwise("group").alias("kind"), F.flatten(F.slice("lines", i * GROUP_STEP + 1, GROUP_LINES)).alias("words"))),
        F.array(F.struct(F.lit("file").alias("kind"), F.flatten("lines").alias("words"))),
    )
    units = some.select("uid", F.posexplode(parts).alias("at", "part")).select("uid", "at", "part.kind", "part.words")
    found = score_words(units, templates, bound).withColumn("score", F.round("score", 6)).filter(F.col("score") >= least)
    found = found.join(_named(files.sparkSession, templates), "template")
    file = (F.col("kind") == "file") | (F.col("kind") == "head") & F.col("whole")
    return found.groupBy("uid").agg(
        F.min(F.struct((~file).alias("part"), (-F.col("score")).alias("less"), "license")).alias("best")
    ).select("uid", "best.license", (-F.col("best.less")).alias("score"), (~F.col("best.part")).alias("is_file"))


def inherit(files: DataFrame, own: DataFrame) -> DataFrame:
    """Every file with its licence: its own, or that of the nearest directory above it.

    Each path meets its ancestors by equality; the directories that have a
    licence file are one row each.
    """
    ancestors = lambda path: F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda i: F.array_join(F.slice(F.split(path, "/"), F.lit(1), i - 1), "/"))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    spoken = own.filter("is_file").join(files.select("uid", "path").filter("path is not null"), "uid")
    folders = spoken.groupBy(folder.alias("dir")).agg(F.min(F.struct(-F.col("score"), "license", "path")).alias("m"))
    folders = folders.select("dir", F.col("m.license").alias("dir_license"), F.col("m.path").alias("dir_path"))
    lacking = files.select("uid", "path").join(own, "uid", "left_anti").filter("path is not null")
    above = lacking.select("uid", F.posexplode(ancestors(F.col("path"))).alias("depth", "dir"))
    nearest = above.join(folders, "dir").groupBy("uid").agg(F.max_by(F.struct("dir_license", "dir_path"), "depth").alias("d"))
    out = files.select("uid", "path").join(own, "uid", "left").join(nearest.select("uid", "d.*"), "uid", "left")
    origin = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "notice").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return out.select("uid", "path", F.coalesce("license", "dir_license").alias("license"), "score", origin.alias("origin"), F.when(F.col("license").isNull(), F.col("dir_path")).alias("from_path"))


def scan_licenses(files: DataFrame, templates: dict[str, str] | list[Template] = ALL, least: float = LEAST) -> DataFrame:
    """Licences of all ``(uid, path, text)`` rows, ``uid`` being unique; the notices are written once."""
    own = common.write_table(scan_files(files, templates, least), "licenses")
    return inherit(files, own)


def op9_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: ``source``, a folder for each 16 ids, and the id."""
    docs = common.read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.expr("cast(doc_id div 16 as string)"), F.col("doc_id").cast("string"))
    files = docs.select(F.col("doc_id").alias("uid"), path.alias("path"), "text")
    return scan_licenses(files).withColumnRenamed("uid", "doc_id")


_VALUES = ", ".join("({}, '{}', '{}', {})".format(i, k, v.replace("'", "''"), str(whole).lower()) for i, (k, v, whole) in enumerate(ALL))
_STOPS = ", ".join(f"'{w}'" for w in sorted(STOP))
OP9_SQL = rf"""
WITH templates(template, license, text, whole) AS (VALUES {_VALUES}),
tt AS (SELECT template, t AS term, count(*) AS tf FROM (SELECT template, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM templates) WHERE t NOT IN ({_STOPS}) GROUP BY 1, 2),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM templates)) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY 1),
tw AS (SELECT template, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY template)) AS weight FROM tt JOIN idf USING (term)),
files AS (SELECT doc_id AS uid, source || '/' || CAST(doc_id // 16 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT uid, 'line' AS kind, i AS pos, string_split(text, chr(10))[i] AS unit FROM files, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i)
  UNION ALL SELECT uid, CASE WHEN i = 0 THEN 'head' ELSE 'group' END, i, array_to_string(string_split(text, chr(10))[i * {GROUP_STEP} + 1:i * {GROUP_STEP} + {GROUP_LINES}], chr(10))
    FROM files, unnest(range(0, CAST(ceil(greatest(len(string_split(text, chr(10))) - {GROUP_LINES}, 0) / {GROUP_STEP}.0) AS BIGINT) + 1)) AS r(i)
  UNION ALL SELECT uid, 'file', 0, text FROM files
), ut AS (
  SELECT uid, kind, pos, t AS term, count(*) AS tf FROM (SELECT uid, kind, pos, unnest(regexp_extract_all(lower(unit), '[a-z0-9]+')) AS t FROM units) WHERE t NOT IN ({_STOPS}) GROUP BY 1, 2, 3, 4
), uw AS (SELECT ut.*, tf * coalesce(idf, ln(1.0 + (SELECT count(*) FROM templates)) + 1) AS w FROM ut LEFT JOIN idf USING (term)),
norms AS (SELECT uid, kind, pos, sqrt(sum(w * w)) AS norm FROM uw GROUP BY 1, 2, 3),
scores AS (
  SELECT uw.uid, uw.kind, uw.pos, template, round(sum(w * weight) / any_value(norm), 6) AS score FROM uw JOIN tw USING (term) JOIN norms n ON n.uid = uw.uid AND n.kind = uw.kind AND n.pos = uw.pos GROUP BY 1, 2, 3, 4
), good AS (SELECT s.*, license, kind = 'file' OR kind = 'head' AND whole AS speaks FROM scores s JOIN templates USING (template) WHERE score >= {LEAST}),
own AS (
  SELECT uid, license, score, is_file FROM (SELECT uid, license, score, bool_or(speaks) OVER (PARTITION BY uid) AS is_file,
    row_number() OVER (PARTITION BY uid ORDER BY speaks DESC, score DESC, license) AS k FROM good) WHERE k = 1
), folders AS (
  SELECT dir, license AS dir_license, path AS dir_path FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, license, path,
    row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, license, path) AS k FROM own JOIN files USING (uid) WHERE is_file) WHERE k = 1
), near AS (
  SELECT uid, dir_license, dir_path FROM (SELECT f.uid, dir_license, dir_path, row_number() OVER (PARTITION BY f.uid ORDER BY length(dir) DESC) AS k
    FROM files f JOIN folders d ON starts_with(f.path, d.dir || '/') WHERE f.uid NOT IN (SELECT uid FROM own)) WHERE k = 1
)
SELECT f.uid AS doc_id, f.path, coalesce(o.license, n.dir_license) AS license, o.score,
  CASE WHEN o.is_file THEN 'file' WHEN o.license IS NOT NULL THEN 'notice' WHEN n.dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, n.dir_path AS from_path
FROM files f LEFT JOIN own o ON o.uid = f.uid LEFT JOIN near n ON n.uid = f.uid
"""
