"""Topics: counts, phrase reviews, relevance, assignment, keywords and candidate ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexflow.functions import text as T

GENERIC = ("evolution", "origin", "origins", "science", "study", "studies")
NOISY = ("boundry", "colloquium", "edition", "history", "idea", "central", "bearing", "time")
#: What a candidate's source is worth before any match (fixed values).
SOURCE_SCORES = {"openalex": 3.0, "pubmed": 2.5, "crossref": 2.0, "datacite": 1.5}


def topics_with_counts(topics: DataFrame, entry_topics: DataFrame, status: str | None = None) -> DataFrame:
    counts = entry_topics.groupBy("slug").agg(F.count("*").alias("entry_count"))
    out = topics.join(counts, "slug", "left").withColumn("entry_count", F.coalesce("entry_count", F.lit(0)))
    return out if status is None else out.filter(F.col("phrase_review_status") == status)


def review_rank(status: Column) -> Column:
    """Pending first, then unreviewed, rejected, accepted, others."""
    return F.when(status == "pending", 0).when(status == "unreviewed", 1).when(status == "rejected", 2).when(status == "accepted", 3).otherwise(4)


def review_phrases(topics: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions ``(slug, decision, phrase)`` applied.

    Accepted: the phrase becomes the override or the suggestion, which goes.
    Rejected: the suggestion stays; an override still applies.
    """
    d = decisions.select("slug", "decision", T.filled("phrase").alias("override"))
    accepted = F.col("decision") == "accepted"
    return topics.join(d, "slug", "left").select(
        *[c for c in topics.columns if c not in ("expansion_phrase", "suggested_phrase", "phrase_review_status")],
        F.when(accepted, F.coalesce("override", "suggested_phrase", "expansion_phrase")).otherwise(F.coalesce("override", "expansion_phrase")).alias("expansion_phrase"),
        F.when(accepted, F.lit(None)).otherwise(F.col("suggested_phrase")).alias("suggested_phrase"),
        F.coalesce("decision", "phrase_review_status").alias("phrase_review_status"),
    )


def stage_phrases(topics: DataFrame, staged: DataFrame) -> DataFrame:
    """Suggestions ``(slug, suggested_phrase)`` put up for review."""
    s = staged.select("slug", F.col("suggested_phrase").alias("_s"))
    return topics.join(s, "slug", "left").withColumns(
        {"suggested_phrase": F.coalesce("_s", "suggested_phrase"), "phrase_review_status": F.when(F.col("_s").isNotNull(), "pending").otherwise(F.col("phrase_review_status"))}
    ).drop("_s")


def relevance(phrase: Column, title="title", abstract="abstract", keywords: Column | None = None, venue: Column | None = None) -> Column:
    """How near an entry is to a phrase, from 0 to 1: overlap of stems with related words."""
    low = lambda c: T.normalize_text(F.lower(T.text(c)))
    within = T.let(F.struct(low(phrase).alias("p"), low(title).alias("t")), lambda s: (s["p"] != "") & (s["t"] != "") & s["t"].contains(s["p"]))

    def scored(terms):
        part = lambda c: T.overlap(terms, T.expanded_terms(T.text(c)))
        score = 0.6 * part(title) + 0.25 * part(abstract)
        score = score + 0.1 * (part(keywords) if keywords is not None else F.lit(0.0)) + 0.05 * (part(venue) if venue is not None else F.lit(0.0))
        return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(score, F.when(within, 0.75).otherwise(0.0))))

    return T.let(T.expanded_terms(phrase), scored)


def title_anchor(phrase: Column, title: Column) -> Column:
    """1 if the title has the phrase, else the share of its own words, at least .25 for any."""
    low = lambda c: T.normalize_text(F.lower(T.text(c)))
    core = F.array_except(T.keyword_terms(phrase), F.array(*map(F.lit, GENERIC)))
    share = T.overlap(core, T.keyword_terms(title))
    within = T.let(F.struct(low(phrase).alias("p"), low(title).alias("t")), lambda s: (s["p"] != "") & (s["t"] != "") & s["t"].contains(s["p"]))
    return F.when(within, 1.0).otherwise(T.let(share, lambda x: F.when(x > 0, F.greatest(F.lit(0.25), x)).otherwise(0.0)))


def assign(entries: DataFrame, phrase: Column, least: float = 0.2) -> DataFrame:
    """Entries near enough to a phrase, with an anchor in the title."""
    venue = F.concat_ws(" ", "journal", "booktitle")
    out = entries.withColumns({"relevance": relevance(phrase, venue=venue), "anchor": title_anchor(phrase, F.col("title"))})
    return out.filter((F.col("relevance") >= least) & (F.col("anchor") >= 0.2))


def topic_keywords(entries: DataFrame, topics: DataFrame, most: int = 4) -> DataFrame:
    """Each topic's keywords: title words by the number of titles that have them."""
    names = topics.select(F.col("slug").alias("topic"), T.topic_tokens(F.col("name")).alias("own"))
    rows = entries.select("topic", F.explode(F.array_distinct(T.topic_tokens(F.col("title")))).alias("term")).groupBy("topic", "term").agg(F.count("*").alias("n"))
    rows = rows.join(names, "topic").filter(~F.array_contains("own", F.col("term")))
    size = entries.groupBy("topic").agg(F.count("*").alias("n_entries"))
    rows = rows.join(size, "topic")
    rank = Window.partitionBy("topic").orderBy(F.desc("n"), "term")
    cap = F.when(F.col("n_entries") <= 1, F.least(F.lit(1), F.lit(most))).when(F.col("n_entries") <= 3, F.least(F.lit(2), F.lit(most))).otherwise(most)
    rows = rows.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= cap)
    rows = rows.withColumn("twice", F.max(F.col("n") >= 2).over(Window.partitionBy("topic"))).filter("not twice or n >= 2")
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])
    return size.join(rows.groupBy("topic").agg(words.alias("keywords")), "topic", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def review_reasons(n_entries: Column, keywords: Column) -> Column:
    noisy = F.exists(keywords, lambda k: (F.length(k) <= 3) | k.rlike("[0-9]") | k.isin(*NOISY))
    return F.array_compact(F.array(
        F.when(n_entries <= 1, "single_entry_topic").when(n_entries <= 3, "small_topic"),
        F.when(F.size(keywords) == 0, "no_keyword_signal").when(F.size(keywords) == 1, "thin_keyword_signal"),
        F.when(noisy, "noisy_keywords"),
    ))


def rank_candidates(candidates: DataFrame, topic: str, seeds: DataFrame, limit: int) -> DataFrame:
    """Candidates ``(citation_key, title, abstract, source)`` by score, the best source of each.

    Base score of the source, words shared with the topic, and a quarter for
    each seed that shares a word with the title.
    """
    words = T.tokens(F.lit(topic))
    base = F.create_map(*[F.lit(x) for kv in SOURCE_SCORES.items() for x in kv])
    shared = F.size(F.array_intersect(words, F.array_union(T.tokens(F.col("title")), T.tokens(F.col("abstract")))))
    # Seeds with a word in common, by equality on the words.
    seed_words = seeds.select(F.col("citation_key").alias("seed"), F.explode(T.tokens(F.col("title"))).alias("word"))
    # Rows of one key and source may differ in title, so seeds are counted for each title.
    rows = candidates.withColumn("_title", T.text("title"))
    titles = rows.select("_title").distinct()
    pairs = titles.select("_title", F.explode(T.tokens(F.col("_title"))).alias("word")).join(seed_words, "word").groupBy("_title").agg(F.count_distinct("seed").alias("n_seeds"))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(SOURCE_SCORES) for x in (k, -i)])
    scored = rows.join(pairs, "_title", "left").withColumn("score", F.coalesce(F.try_element_at(base, F.col("source")), F.lit(0.0)) + shared + 0.25 * F.coalesce("n_seeds", F.lit(0)))
    best = scored.groupBy("citation_key").agg(F.max_by(F.struct("title", "source", "score"), F.struct("score", F.try_element_at(order, F.col("source")))).alias("b"))
    return best.select("citation_key", "b.*").orderBy(F.desc("score"), "citation_key").limit(limit)
