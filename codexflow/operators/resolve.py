"""Verification, matching and resolution of entries against candidates.

Queries meet candidates by shared title words, never by a cross join, and only
rare words make pairs. What very many titles have in common is told by groups
of candidates that hold their first ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexflow.functions import bibliographic as B
from codexflow.functions import text as T
from codexflow.operators import lineage


def query_fields(value: Column) -> Column:
    """Year, quoted title and first author of a free-text query."""
    year = F.regexp_extract(value, B.QUERY_YEAR, 1)
    quoted = F.regexp_extract(value, "[\"“”‘’'`](.+?)[\"“”‘’'`]", 0)
    title = F.trim(F.regexp_extract(value, "[\"“”‘’'`](.+?)[\"“”‘’'`]", 1))
    rest = F.when(quoted != "", F.replace(value, quoted, F.lit(" "))).otherwise(value)
    rest = F.when(year != "", F.replace(rest, year, F.lit(" "))).otherwise(rest)
    words = F.filter(F.transform(F.split(rest, r"\s+"), lambda w: T.strip_chars(w, ",.;:")), lambda w: w != "")
    return F.struct(title.alias("title"), F.coalesce(F.get(words, 0), F.lit("")).alias("author"), year.alias("year"))


def first_surname(author: Column) -> Column:
    """The first author's surname, or nothing."""
    return F.coalesce(T.surname(F.get(T.names(author), 0)), F.lit(""))


def match_score(share: Column, q_surname: Column, c_surname: Column, q_year: Column, c_year: Column) -> Column:
    """How well a candidate fits: the share of the query's title words, first author's surname, year."""
    title = F.when(share >= 0.9, 0.55).when(share >= 0.7, 0.40).when(share >= 0.5, 0.20).otherwise(0.0)
    author = F.when((q_surname != "") & (q_surname == c_surname), 0.25).otherwise(0.0)
    near = F.coalesce(F.abs(q_year.try_cast("int") - c_year.try_cast("int")) == 1, F.lit(False))
    year = F.when((q_year == "") | (c_year == ""), 0.0).when(q_year == c_year, 0.15).when(near, 0.07).otherwise(0.0)
    return F.least(title + author + year, F.lit(1.0))


def match_status(score: Column, doi: Column) -> Column:
    return F.when(score.isNull(), "not_found").when(T.filled(doi).isNotNull() & (score >= 0.95), "exact").when(score >= 0.75, "high_confidence").otherwise("ambiguous")


#: A word of more candidates is frequent: those meet by groups of what they share, not in pairs.
RARE = 64
#: More frequent words than these in one title aren't taken in all their combinations.
MANY = 12
#: Groups of more candidates are asked for their best ones.
SMALL = 16
#: Shares of a query's words, in tenths, that the score tells apart.
_SHARES = (9, 7, 5)


def _by_rarity(titles: DataFrame, often: DataFrame) -> DataFrame:
    """``by``: the words of each ``title`` with how many candidates' titles have them, the rarest first."""
    words = titles.select("title", F.explode("words").alias("word")).join(often, "word", "left")
    by = F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word")))
    found = words.groupBy("title").agg(by.alias("by"))
    words = lambda kept: F.array_sort(F.transform(kept, lambda x: x["word"]))
    return found.select("title", "by", words(F.col("by")).alias("words"), words(F.filter("by", lambda x: x["often"] > RARE)).alias("frequent"))


def _subsets(words: Column) -> Column:
    """All combinations of words, each as its size and a text; the empty one too."""
    start = F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("grp")))
    more = lambda w: lambda x: F.struct((x["n"] + 1).alias("n"), F.concat(x["grp"], F.lit(" "), w).alias("grp"))
    return F.aggregate(words, start, lambda made, w: F.concat(made, F.transform(made, more(w))))


def _list_keys(surname: Column, year: Column, near: tuple[Column, ...]) -> Column:
    """The lists of a group by surname and year: ``near`` are years as numbers. Missing values have none."""
    key = lambda kind, a, b: F.concat_ws("|", F.lit(kind), a, b)
    any_, has_s, has_y = F.lit(""), surname != "", year != ""
    keys = [key("all", any_, any_), F.when(has_s, key("s", surname, any_)), F.when(has_y, key("y", any_, year)), F.when(has_s & has_y, key("sy", surname, year))]
    for n in near:
        keys += [key("n", any_, n.cast("string")), F.when(has_s, key("sn", surname, n.cast("string")))]
    made = [F.when(n.isNotNull(), k) if i >= 4 else k for i, (k, n) in enumerate(zip(keys, [F.lit(0)] * 4 + [n for n in near for _ in (0, 1)]))]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def scored_candidates(q: DataFrame, c: DataFrame, keep: int) -> DataFrame:
    """Scores of candidates ``c`` for queries ``q``, at least the best ``keep`` of each query.

    Titles of equal words are one. Titles with a rare word in common meet by it,
    and their share is counted. What else is in common are frequent words: titles
    are grouped by every combination of theirs that some query asks for, one
    that makes up 0.5, 0.7 or 0.9 of its words. A group's lists, of all and of
    each surname, year and neighbouring year, hold their first ``keep``: whoever
    stands before a candidate there has no lower score, so a query's best are
    in its lists, and pairs don't grow with the square of a group. Titles of
    more than ``MANY`` frequent words meet by words.
    """
    titles = lambda df: df.select("title", "words").dropDuplicates(["title"])
    often = titles(c).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("often"))
    held = lineage.written(_by_rarity(titles(c), often), "candidates").withColumn("long", F.size("frequent") > MANY)
    ask = lineage.written(_by_rarity(titles(q), often), "queries").withColumn("long", F.size("frequent") > MANY)
    score = F.round(match_score(*map(F.col, ("share", "q_surname", "c_surname", "q_year", "c_year"))), 4)
    scored = lambda df: df.select("query_id", "work", "citation_key", "has_doi", "year", score.alias("score"))

    # The rarest n - need + 1 of a query's words have one of those in common.
    n = F.size("words")
    need = {t: F.floor((n * t + 9) / 10).cast("int") for t in _SHARES}
    prefix = F.slice("by", F.lit(1), n - need[5] + 1)

    def met(asked: DataFrame, posts: DataFrame, of_query: Column, of_candidate: Column) -> DataFrame:
        a = asked.select("title", F.col("words").alias("q_words"), F.explode(F.transform(of_query, lambda x: x["word"])).alias("word"))
        p = posts.select(F.col("title").alias("grp"), F.col("words").alias("c_words"), F.explode(F.transform(of_candidate, lambda x: x["word"])).alias("word"))
        return a.join(p, "word").withColumn("share", T.overlap(F.col("q_words"), F.col("c_words"))).filter("share >= 0.5").select("title", "grp", "share")

    rare = lambda x: F.filter(x, lambda w: (w["often"] > 0) & (w["often"] <= RARE))
    common = lambda x: F.filter(x, lambda w: w["often"] > RARE)
    direct = met(ask, held, rare(prefix), rare(F.col("by")))
    if ask.filter("long").limit(1).count():
        direct = direct.unionByName(met(ask.filter("long"), held, common(prefix), common(F.col("by"))))
    if held.filter("long").limit(1).count():
        direct = direct.unionByName(met(ask.filter("not long"), held.filter("long"), common(prefix), common(F.col("by"))))
    direct = lineage.written(direct.distinct(), "direct")

    sets = F.explode(F.filter(_subsets(F.col("frequent")), lambda x: (x["n"] > 0) & ((x["n"] == F.col("n5")) | (x["n"] == F.col("n7")) | (x["n"] == F.col("n9")))))
    subsets = ask.filter("not long").select("title", "frequent", *[need[t].alias(f"n{t}") for t in _SHARES]).filter("size(frequent) >= n5").withColumn("x", sets)
    share = F.when(F.col("x.n") == F.col("n9"), 0.9).when(F.col("x.n") == F.col("n7"), 0.7).otherwise(0.5)
    subsets = lineage.written(subsets.select("title", "x.grp", share.alias("share")), "subsets")
    having = held.filter("not long").select("title", F.explode(_subsets(F.col("frequent"))).alias("x")).filter("x.n > 0").select("title", "x.grp")
    having = having.join(subsets.select("grp").distinct(), "grp", "left_semi").select("title", "grp")
    having = having.unionByName(direct.select(F.col("grp").alias("title"), "grp").distinct())
    members = lineage.written(having.join(c.drop("words"), "title").drop("title"), "groups")
    large = lineage.written(members.groupBy("grp").agg(F.count("*").alias("held")).filter(F.col("held") > SMALL).select("grp"), "large")
    asked = lineage.written(direct.unionByName(subsets).join(q.drop("words"), "title").drop("title"), "asked")
    small = scored(asked.join(members.join(large, "grp", "left_anti"), "grp"))

    number = F.col("c_year").try_cast("int").cast("long")
    lists = members.join(large, "grp").withColumn("list", F.explode(_list_keys(F.col("c_surname"), F.col("c_year"), (number,))))
    first = Window.partitionBy("grp", "list").orderBy("year", "citation_key", "work")
    lists = lists.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= keep).drop("_r")
    number = F.col("q_year").try_cast("int").cast("long")
    asks = asked.join(large, "grp").withColumn("list", F.explode(_list_keys(F.col("q_surname"), F.col("q_year"), (number - 1, number + 1))))
    return small.unionByName(scored(asks.join(lists, ["grp", "list"])))


def verify(queries: DataFrame, candidates: DataFrame, keep: int = 4) -> DataFrame:
    """The best candidate and alternates of each query ``(query_id, title, author, year)``.

    One row for each kept candidate, by ``rank``; queries without any have one
    row with the status ``not_found``. A candidate counts if it has at least
    half of the query's title words.
    """
    facts = lambda p: [F.array_sort(T.tokens(F.col("title"))).alias("words"), first_surname(F.col("author")).alias(f"{p}_surname"), F.trim(T.text("year")).alias(f"{p}_year")]
    title = F.array_join("words", " ").alias("title")
    # Works that agree in doi, title and year count once: so do their words. A work's doi and title go as a hash of 64 bits.
    work = F.xxhash64(F.lower(T.text("doi")), T.collapse(F.lower(T.text("title"))), T.text("year")).alias("work")
    c = candidates.select(work, "citation_key", T.filled("doi").isNotNull().alias("has_doi"), T.text("year").alias("year"), *facts("c"))
    c = c.groupBy("work").agg(F.min(F.struct("citation_key", "has_doi", "year", "words", "c_surname", "c_year")).alias("first")).select("work", "first.*")
    # Of candidates that no query can tell apart the first ones are enough.
    same = Window.partitionBy("words", "c_surname", "year").orderBy("citation_key", "work")
    c = c.withColumn("_r", F.row_number().over(same)).filter(F.col("_r") <= keep).drop("_r")
    c = lineage.written(c.filter("size(words) > 0").select("*", title), "works")
    asked = lineage.written(queries.select("query_id", *facts("q")).select("*", title), "asked")
    pairs = scored_candidates(asked, c, keep).repartition("query_id")
    # A candidate found in several ways has its highest score.
    pairs = pairs.groupBy("query_id", "work").agg(F.max("score").alias("score"), *[F.first(x).alias(x) for x in ("citation_key", "has_doi", "year")])
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "year", "citation_key", "work")
    best = pairs.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= keep).select("query_id", "rank", "citation_key", "score", "has_doi")
    out = asked.select("query_id").join(best, "query_id", "left").withColumn("rank", F.coalesce("rank", F.lit(1)))
    doi = F.when(F.col("has_doi"), "x")
    return out.select("query_id", "rank", "citation_key", "score", match_status(F.col("score"), doi).alias("status"))


def exact_matches(queries: DataFrame, candidates: DataFrame, others_only: bool = False) -> DataFrame:
    """The first candidate by ordinal with the same normalised title, no other year, and a common author word.

    With ``others_only`` a candidate whose ordinal is the query's id is the
    query itself and doesn't count. Candidates that agree in title, year and
    author words are told by their first two, so copies don't meet in pairs.
    """
    q = queries.select("query_id", T.match_text(F.col("title")).alias("t"), T.text("year").alias("q_year"), T.author_tokens(F.col("author")).alias("q_authors")).filter("t <> ''")
    c = candidates.select("citation_key", "ordinal", T.match_text(F.col("title")).alias("t"), T.text("year").alias("c_year"), T.author_tokens(F.col("author")).alias("c_authors"))
    ok = ((F.col("q_year") == "") | (F.col("c_year") == "") | (F.col("q_year") == F.col("c_year"))) & ((F.size("q_authors") == 0) | F.arrays_overlap("q_authors", "c_authors"))
    first = Window.partitionBy("t", "c_year", "c_authors").orderBy("ordinal", "citation_key")
    c = c.withColumn("_r", F.row_number().over(first)).filter("_r <= 2").drop("_r")
    if others_only:
        ok = ok & (F.col("ordinal") != F.col("query_id"))
    return q.join(c, "t").filter(ok).groupBy("query_id").agg(F.min_by("citation_key", "ordinal").alias("citation_key"))


def _asked_years(pairs: DataFrame) -> DataFrame:
    """A query's year meets the same year or none; a query without a year meets any."""
    ask = lambda any_year, year: F.struct(F.lit(any_year).alias("any_year"), year.alias("c_year"))
    asks = F.when(F.col("q_year") == "", F.array(ask(True, F.lit("")))).otherwise(F.array(ask(False, F.col("q_year")), ask(False, F.lit(""))))
    return pairs.withColumn("ask", F.explode(asks)).select("*", "ask.*").drop("ask")


def _size_level(n: Column) -> Column:
    """Sizes up to 16 have their own level, larger ones four levels for each doubling."""
    return F.when(n <= 16, n).otherwise(F.floor(F.log2(n / 16) * 4) + 16).cast("int")


def similar_sets(asked: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs of distinct word sets ``q`` and ``c`` with their Jaccard similarity ``score``, at least ``least``.

    Sets of n and m words share ``o >= least / (1 + least) * (n + m)``, so they
    meet in the rarest ``n - o + 1`` and ``m - o + 1`` of their words.
    """
    often = sets.select(F.explode("c").alias("word")).groupBy("word").agg(F.count("*").alias("often"))

    def ordered(df: DataFrame, c: str) -> DataFrame:
        words = df.select(c, F.explode(c).alias("word")).join(often, "word", "left")
        by = F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word")))
        return words.groupBy(c).agg(by.alias("by")).withColumn("n", F.size(c))

    # Half of the last digit that is kept, and a little for the doubles.
    low = least - 1e-6
    common = lambda n, m: F.greatest(F.ceil((n + m) * (low / (1 + low)) - 1e-9), F.lit(1))
    q = ordered(asked, "q").withColumn("level", F.explode(F.sequence(_size_level(F.ceil(F.col("n") * low)), _size_level(F.floor(F.col("n") / low)))))
    smallest = F.greatest(F.when(F.col("level") <= 16, F.col("level")).otherwise(F.floor(16 * F.pow(F.lit(2.0), (F.col("level") - 16) / 4))), F.ceil(F.col("n") * low))
    q = q.select("q", "n", "level", F.posexplode(F.slice("by", F.lit(1), (F.col("n") - common(F.col("n"), smallest) + 1).cast("int"))).alias("i", "w")).select("q", "n", "level", "i", "w.word")
    c = ordered(sets, "c").withColumnRenamed("n", "m")
    c = c.select("c", "m", _size_level(F.col("m")).alias("level"), F.posexplode(F.slice("by", F.lit(1), (F.col("m") - F.ceil(F.col("m") * low - 1e-9) + 1).cast("int"))).alias("j", "w")).select("c", "m", "level", "j", "w.word")
    need = common(F.col("n"), F.col("m"))
    pairs = q.join(c, ["word", "level"]).filter((F.col("i") <= F.col("n") - need) & (F.col("j") <= F.col("m") - need)).select("q", "c").distinct()
    return pairs.withColumn("score", F.round(T.jaccard(F.col("q"), F.col("c")), 6)).filter(F.col("score") >= least)


def catalog_matches(queries: DataFrame, candidates: DataFrame, least: float = 0.6) -> DataFrame:
    """The candidate with the highest Jaccard similarity of title words, at least ``least``.

    Candidates of equal words and year are told by their first key. No set is
    more similar than an equal one, so only queries without such a candidate
    are compared with other sets.
    """
    words = F.array_sort(T.catalog_tokens(F.col("title")))
    q = lineage.written(queries.select("query_id", words.alias("q"), T.text("year").alias("q_year")).filter("size(q) > 0"), "queries")
    c = candidates.select("citation_key", words.alias("c"), T.text("year").alias("c_year")).filter("size(c) > 0")
    years = c.groupBy("c", "c_year").agg(F.min("citation_key").alias("citation_key"))
    both = F.explode(F.array(F.struct(F.lit(False).alias("any_year"), F.col("c_year")), F.struct(F.lit(True).alias("any_year"), F.lit("").alias("c_year"))))
    firsts = years.select("c", "citation_key", both.alias("b")).groupBy("c", "b.any_year", "b.c_year").agg(F.min("citation_key").alias("citation_key"))
    firsts = lineage.written(firsts, "titles")
    on = ["c", "any_year", "c_year"]
    same = _asked_years(q.withColumnRenamed("q", "c")).join(firsts, on).select("query_id", F.lit(1.0).alias("score"), "citation_key")
    same = lineage.written(same.groupBy("query_id", "score").agg(F.min("citation_key").alias("citation_key")), "same")
    rest = q.join(same, "query_id", "left_anti")
    if not rest.limit(1).count():
        return same.select("query_id", "citation_key", "score")
    pairs = similar_sets(rest.select("q").distinct(), firsts.filter("any_year").select("c"), least)
    found = _asked_years(rest.join(pairs, "q")).join(firsts, on).select("query_id", "score", "citation_key")
    best = F.min(F.struct((-F.col("score")).alias("s"), "citation_key"))
    return same.unionByName(found).groupBy("query_id").agg(best.alias("b")).select("query_id", "b.citation_key", (-F.col("b.s")).alias("score"))


#: The order in which sources are asked (fixed values).
CASCADE = ("crossref", "datacite", "europepmc", "semanticscholar", "pubmed", "openalex", "dblp", "arxiv", "openlibrary")


def cascade(candidates: DataFrame) -> DataFrame:
    """Of candidates ``(citation_key, source, found)`` the first source that found one, with the trace of attempts."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(CASCADE) for x in (s, i)])
    rows = candidates.withColumn("p", F.coalesce(F.try_element_at(order, F.col("source")), F.lit(len(CASCADE))))
    hit = F.min(F.when(F.col("found"), F.col("p"))).over(Window.partitionBy("citation_key"))
    rows = rows.withColumn("winner", hit).filter((F.col("p") <= F.col("winner")) | F.col("winner").isNull())
    trace = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "source"))), lambda x: x["source"]), ">")
    return rows.groupBy("citation_key").agg(F.min_by("source", F.when(F.col("p") == F.col("winner"), F.col("p"))).alias("source"), trace.alias("attempts"))


def prefers_catalog() -> Column:
    """Entries better looked for in book catalogues."""
    venue, title = T.match_text(F.concat_ws(" ", "publisher", "booktitle")), T.match_text(F.col("title"))
    return F.col("entry_type").isin("book", "incollection", "phdthesis", "mastersthesis") | (
        (F.col("entry_type") == "misc") & (venue.rlike("press|university|house|dictionary|christendom") | title.rlike("dictionary|history|world|universe|record"))
    )


def merge_hints(queries: DataFrame, hints: DataFrame) -> DataFrame:
    """Hints ``(query_id, title, author, year)`` fill only what a query lacks."""
    h = hints.select("query_id", *[F.col(c).alias(f"_{c}") for c in ("title", "author", "year")])
    return queries.join(h, "query_id", "left").select("query_id", *[F.coalesce(T.filled(c), F.col(f"_{c}"), F.lit("")).alias(c) for c in ("title", "author", "year")])


def rerank_ties(ranked: DataFrame, order: DataFrame) -> DataFrame:
    """Equal scores follow an order ``(query_id, citation_key, position)``; those without one come last."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce("position", F.lit(2**31 - 1)), "rank")
    return ranked.join(order, ["query_id", "citation_key"], "left").withColumn("rank", F.row_number().over(w)).drop("position")
