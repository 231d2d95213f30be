"""Ranked search over documents: derivation, filters, scores, suggestions, facets.

A short list of queries becomes conditions of the plan, so one pass over the
documents answers all of them: no product of two tables is formed, and only
matching (query, document) rows leave the scan. A table of queries is joined with
the documents on rare runs of characters (``search_table``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.keys import (
    code_unit_order, fold_text, nfkc, normalize_alias, normalize_query,
)
from ..functions.labels import display_title, facet_label, item_category_label, stat_search_key
from ..functions.lexemes import SAFE_INTEGER, distance_limit
from ..session import durable

# Route segments, scores, limits and facet groups.
SEGMENTS = {
    "item": "items", "recipe": "recipes", "encrustment": "encrustments", "skill": "skills", "ability": "abilities",
    "spell": "spells", "monster": "monsters", "stat": "stats", "template": "templates",
}
EXACT, PREFIX, INSIDE, TOKEN_IN_NAME, TOKEN_ELSEWHERE = 300, 200, 100, 20, 2
SUGGESTION_LIMIT = 5
SHORTEST_SUGGESTED, LONGEST_SUGGESTED = 3, 120
CRAFTING_KINDS = ["recipe", "encrustment"]
CATEGORY_GROUPS = [
    ("crafting-tools", "Crafting tools", ["recipe", "encrustment"]),
    ("item-categories", "Item categories", ["item"]),
    ("monster-taxonomies", "Monster taxonomies", ["monster"]),
    ("skill-archetypes", "Skill archetypes", ["skill"]),
    ("stat-groups", "Stat groups", ["stat"]),
]


@dataclass(frozen=True)
class SearchQuery:
    id: str
    query: str = ""
    kinds: list[str] = field(default_factory=list)
    source_ids: list[str] = field(default_factory=list)
    category: str | None = None
    stat_key: str | None = None
    max_skill: int | None = None
    limit: int | None = None

    def __post_init__(self):
        if self.max_skill is not None and not 0 <= self.max_skill <= SAFE_INTEGER:
            raise ValueError("the skill bound must be a non-negative integer")


# The saved filter views.
SAVED_VIEWS = [
    SearchQuery("all-crafting", kinds=CRAFTING_KINDS),
    SearchQuery("early-crafting", kinds=CRAFTING_KINDS, max_skill=2),
]


def passes_filter(q: SearchQuery) -> Column:
    """Every filter the query sets holds; an empty list or text sets none."""
    checks = []
    if q.kinds:
        checks.append(F.col("kind").isin(*q.kinds))
    if q.source_ids:
        checks.append(F.col("source_id").isin(*q.source_ids))
    if q.category:
        checks.append(F.col("category") == q.category)
    if q.stat_key:
        checks.append(F.array_contains("stat_keys", q.stat_key))
    if q.max_skill is not None:
        checks.append(F.col("skill_level") <= q.max_skill)
    return reduce(lambda left, right: left & right, checks, F.lit(True))


def contains_tokens(text: Column, query: str) -> Column:
    """Every word of the (folded) query occurs in the text."""
    tokens = [F.contains(text, F.lit(t)) for t in query.split(" ") if t]
    return reduce(lambda left, right: left & right, tokens, F.lit(True))


def text_score(name: Column, query: str) -> Column:
    """Score of a matching document; ``name`` is already normalised."""
    if not query:
        return F.lit(0)
    whole = (
        F.when(name == query, EXACT).when(F.startswith(name, F.lit(query)), PREFIX).when(F.contains(name, F.lit(query)), INSIDE)
        .otherwise(0)
    )
    tokens = [F.when(F.contains(name, F.lit(t)), TOKEN_IN_NAME).otherwise(TOKEN_ELSEWHERE) for t in query.split(" ")]
    return reduce(lambda left, right: left + right, tokens, whole)


def result_order() -> list[Column]:
    return [F.col("score").desc(), F.col("kind"), code_unit_order(F.col("name")), code_unit_order(F.col("id"))]


def with_search_name(documents: DataFrame) -> DataFrame:
    return documents.withColumn("search_name", normalize_query(F.col("name")))


def matches(documents: DataFrame, queries: list[SearchQuery]) -> DataFrame:
    """(query_id, document, score) for every match of every query.

    Each query is a plain compiled condition over the document's columns; the
    scan tests all of them and hands on matching rows only.
    """
    named = documents if "search_name" in documents.columns else with_search_name(documents)
    hits = []
    for q in queries:
        text = fold_text(q.query)
        found = F.struct(F.lit(q.id).alias("id"), text_score(F.col("search_name"), text).cast("bigint").alias("score"),
                         F.lit(q.limit).cast("bigint").alias("limit"))
        hits.append(F.when(passes_filter(q) & contains_tokens(F.col("text"), text), found))
    exploded = named.select("id", "kind", "name", "category", F.explode(F.array_compact(F.array(*hits))).alias("q"))
    return exploded.select(F.col("q.id").alias("query_id"), "id", "kind", "name", "category", F.col("q.score").alias("score"),
                           F.col("q.limit").alias("limit"))


def search(documents: DataFrame, queries: list[SearchQuery]) -> DataFrame:
    """Ranked results per query, cut at each query's own limit where it has one.

    Limits are applied with a rank that Spark prunes inside each map task before
    it shuffles, so a query that matches most documents stays cheap.
    """
    unlimited = [q for q in queries if q.limit is None]
    limited = [q for q in queries if q.limit is not None]
    found = None
    if unlimited:
        # The matches are shuffled before the sort, which samples its input: the scan is not repeated for it.
        found = matches(documents, unlimited).drop("limit").repartition("query_id", "id")
    if limited:
        top = max(q.limit for q in limited)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*result_order()))
        cut = matches(documents, limited).withColumn("_rank", rank).filter(F.col("_rank") <= top).filter(
            F.col("_rank") <= F.col("limit")).drop("_rank", "limit")
        found = cut if found is None else found.unionByName(cut)
    return found.orderBy("query_id", *result_order())


# Longest runs of characters that queries are looked up by; words that are shorter are looked up whole.
GRAM = 6
# Queries without a word meet every document; so many parts of the documents meet them separately.
SPREAD = 16
ASKED = "query_id string, query string, kinds array<string>, source_ids array<string>, category string, stat_key string, max_skill bigint, limit bigint"


def query_table(spark: SparkSession, queries: list[SearchQuery]) -> DataFrame:
    rows = [(q.id, q.query, q.kinds, q.source_ids, q.category, q.stat_key, q.max_skill, q.limit) for q in queries]
    return spark.createDataFrame(rows, ASKED)


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of so many characters, in one pass over the text; none for a shorter one."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _word_grams(word: Column) -> Column:
    """The runs of a word: those of ``GRAM`` characters, or the word if it is shorter."""
    return F.when(F.length(word) >= GRAM, _grams(word, GRAM)).otherwise(F.array(word))


def _asked(queries: DataFrame) -> DataFrame:
    """Queries with their folded text, its words, and their filters under other names."""
    folded = queries.withColumn("folded", normalize_query(F.coalesce("query", F.lit(""))))
    return folded.select(
        "query_id", "folded", F.filter(F.split("folded", " "), lambda t: t != "").alias("tokens"), "limit", F.col("kinds").alias("_kinds"), F.col("source_ids").alias("_sources"),
        F.col("category").alias("_category"), F.col("stat_key").alias("_stat"), F.col("max_skill").alias("_skill"))


def _holds() -> Column:
    """Whether a document passes the filters of a query of :func:`_asked` that stands beside it."""
    def unset_or(condition: Column, *given: Column) -> Column:
        return reduce(lambda left, right: left | right, given) | F.coalesce(condition, F.lit(False))

    return (
        unset_or(F.array_contains("_kinds", F.col("kind")), F.col("_kinds").isNull(), F.size("_kinds") <= 0)
        & unset_or(F.array_contains("_sources", F.col("source_id")), F.col("_sources").isNull(), F.size("_sources") <= 0)
        & unset_or(F.col("category") == F.col("_category"), F.coalesce("_category", F.lit("")) == "")
        & unset_or(F.array_contains("stat_keys", F.col("_stat")), F.coalesce("_stat", F.lit("")) == "")
        & unset_or(F.col("skill_level") <= F.col("_skill"), F.col("_skill").isNull())
    )


def matches_table(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, document, score, limit) for every match of any number of queries, given as a table.

    ``queries`` has the columns of ``ASKED``; nulls and empty lists filter nothing. A
    document can only match if it has every run of up to ``GRAM`` characters of the query's
    words, so each query is joined on the one of its runs that the fewest documents
    have. Only ids travel with the runs, and only with those that some query asks for;
    candidates fetch their document afterwards and are tested in full.
    """
    spark = documents.sparkSession
    named = documents if "search_name" in documents.columns else with_search_name(documents)
    docs = named.select("id", "kind", "name", "source_id", "category", "skill_level", "stat_keys", "text", "search_name")
    asked = durable(_asked(queries))
    runs = durable(asked.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform("tokens", _word_grams)))).alias("gram")))
    wanted = runs.select("gram").distinct()
    sizes = [r[0] for r in wanted.select(F.length("gram")).distinct().collect()]  # at most GRAM numbers
    parts = [_grams(F.col("text"), size) for size in sizes] or [F.array().cast("array<string>")]
    listed = docs.select("id", F.explode(F.concat(*parts)).alias("gram")).join(wanted, "gram", "left_semi")
    postings = durable(listed)
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    # A run that no document has settles its query: nothing matches.
    rarest = runs.join(counts, "gram", "left").groupBy("query_id").agg(F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram"))
    worded = postings.join(rarest, "gram").select("query_id", "id")
    silent = asked.filter(F.size("tokens") == 0)
    candidates = docs.join(worded, "id").join(asked, "query_id")
    if not silent.isEmpty():
        spread = spark.range(SPREAD).select(F.col("id").cast("int").alias("_part"))
        parted = docs.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int"))
        every = parted.join(silent.join(F.broadcast(spread), how="cross"), "_part").drop("_part")
        candidates = candidates.unionByName(every.select(*candidates.columns))

    name, folded = F.col("search_name"), F.col("folded")
    holds = _holds() & F.forall("tokens", lambda t: F.contains("text", t))
    whole = F.when(name == folded, EXACT).when(F.startswith(name, folded), PREFIX).when(F.contains(name, folded), INSIDE).otherwise(0)
    by_word = F.aggregate("tokens", F.lit(0), lambda n, t: n + F.when(F.contains(name, t), TOKEN_IN_NAME).otherwise(TOKEN_ELSEWHERE))
    score = F.when(folded == "", 0).otherwise(whole + by_word).cast("bigint")
    return candidates.filter(holds).select("query_id", "id", "kind", "name", "category", score.alias("score"), "limit")


def search_table(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """Ranked results of :func:`matches_table`, cut at each query's own limit where it has one."""
    hits = matches_table(documents, queries)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*result_order()))
    unlimited = hits.filter("limit is null").drop("limit")
    cut = hits.filter("limit is not null").withColumn("_rank", rank).filter("_rank <= limit").drop("_rank", "limit")
    return unlimited.unionByName(cut).orderBy("query_id", *result_order())


def closest(query: str) -> Column:
    """Best (distance, length difference, alias flag) of a document's name and aliases within the edit limit, or null.

    The length difference is tested first; only names that pass it are compared.
    """
    width = len(query)

    def measured(value: Column, alias: int) -> Column:
        gap = F.abs(F.length(value) - width)
        limit = distance_limit(F.greatest(F.lit(width), F.length(value)))
        edits = F.when(gap <= limit, F.call_function("levenshtein", value, F.lit(query), limit))
        return F.struct(edits.alias("distance"), gap.alias("gap"), F.lit(alias).alias("alias"))

    tried = F.concat(F.array(measured(F.col("search_name"), 0)), F.transform("search_aliases", lambda a: measured(a, 1)))
    return F.array_min(F.filter(tried, lambda m: m["distance"] >= 0))


# ---- suggestions by index ------------------------------------------------------

def cut_at(named: DataFrame, length: Column) -> DataFrame:
    """Each row once per part of a name of this length, with ``part``, ``start`` and ``size``.

    There is one part more than the edits any query may be away, as the longest query in
    reach has the widest limit. Parts differ by one character at most.
    """
    parts = (distance_limit(length + 5) + 1).cast("int")
    counted = named.withColumn("_parts", parts).withColumn("_small", F.floor(length / F.col("_parts")).cast("int")).withColumn("_short", F.col("_parts") - F.pmod(length, F.col("_parts")).cast("int"))
    numbered = counted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    start = F.col("part") * F.col("_small") + F.greatest(F.lit(0), F.col("part") - F.col("_short")) + 1
    size = F.col("_small") + F.when(F.col("part") >= F.col("_short"), 1).otherwise(0)
    return numbered.withColumn("start", start).withColumn("size", size).drop("_parts", "_small", "_short")


def name_keys(values: DataFrame) -> DataFrame:
    """(value, width, part, piece): the pieces of each distinct name or alias."""
    wide = values.withColumn("width", F.length("value")).filter("width >= 2")
    return cut_at(wide, F.col("width")).select("value", "width", "part", F.substring("value", F.col("start"), F.col("size")).alias("piece"))


def query_keys(texts: DataFrame) -> DataFrame:
    """(query_id, width, part, piece): where the pieces of a name in reach could stand in a query.

    If the query is at most k edits away, one of the k + 1 or more pieces is untouched,
    and shifted by k characters at most; so every run of the query at such a place, for
    every length that a name in reach can have, is a key.
    """
    length = F.length("folded")
    reach = distance_limit(length + 5).cast("int")  # an upper bound of the limit for any name in reach
    widths = F.sequence(F.greatest(F.lit(2), length - reach), length + reach)
    placed = texts.withColumn("_reach", reach).select("query_id", "folded", "_reach", F.explode(widths).alias("width"))
    limit = distance_limit(F.greatest(F.length("folded"), F.col("width")))
    near = cut_at(placed.filter(F.abs(F.length("folded") - F.col("width")) <= limit).withColumn("_limit", limit), F.col("width"))
    first = F.greatest(F.lit(1), F.col("start") - F.col("_limit"))
    last = F.least(F.length("folded") - F.col("size") + 1, F.col("start") + F.col("_limit"))
    starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda at: F.substring("folded", at, F.col("size")))
    return near.select("query_id", "width", "part", F.explode(F.array_distinct(pieces)).alias("piece"))


def near_values(values: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, value, distance, gap) of the distinct ``values`` within the edit limit of each ``folded`` text; equal texts are looked up once."""
    texts = asked.select(F.col("folded").alias("query_id"), "folded").distinct()
    pairs = name_keys(values).join(query_keys(texts), ["width", "part", "piece"]).select(F.col("query_id").alias("folded"), "value").distinct()
    gap, limit = F.abs(F.length("value") - F.length("folded")), distance_limit(F.greatest(F.length("value"), F.length("folded")))
    edits = F.when(gap <= limit, F.call_function("levenshtein", F.col("value"), F.col("folded"), limit))
    met = pairs.select("folded", "value", edits.alias("distance"), gap.alias("gap")).filter("distance >= 0")
    return asked.select("query_id", "folded").join(met, "folded").drop("folded")


def suggest_table(documents: DataFrame, queries: DataFrame, answered: DataFrame | None = None) -> DataFrame:
    """Spelling suggestions for queries of a table (columns of ``ASKED``) that match nothing: at most five names each.

    ``answered`` lists the queries that match something; it is worked out when not given.
    Names and aliases are looked up by their pieces once per distinct text, whoever has it.
    """
    named = documents if "search_name" in documents.columns else with_search_name(documents)
    worth = F.length("folded").between(SHORTEST_SUGGESTED, LONGEST_SUGGESTED)
    same = ["folded", "_kinds", "_sources", "_category", "_stat", "_skill"]
    # Queries that ask the same are answered once, under the name of the first of them; only their limits differ.
    told = durable(_asked(queries).filter(worth).withColumn("asked_as", F.min("query_id").over(Window.partitionBy(*same))))
    firsts = told.filter("query_id = asked_as")
    if answered is None:
        answered = matches_table(named, queries.join(firsts.select("query_id"), "query_id", "left_semi")).select("query_id").distinct()
    else:
        answered = told.join(answered, "query_id", "left_semi").select(F.col("asked_as").alias("query_id")).distinct()
    asked = durable(firsts.join(answered, "query_id", "left_anti").drop("asked_as", "limit"))
    known = F.array(F.struct(F.col("search_name").alias("value"), F.lit(0).alias("alias")))
    others = F.transform("aliases", lambda a: F.struct(normalize_alias(a, ascii_text=True).alias("value"), F.lit(1).alias("alias")))
    called = durable(named.select("id", F.explode(F.concat(known, others)).alias("v")).select("id", "v.value", "v.alias"))
    found = near_values(called.select("value").distinct(), asked.select("query_id", "folded"))
    per_document = called.join(found, "value").groupBy("query_id", "id").agg(F.min(F.struct("distance", "gap", "alias")).alias("m"))
    columns = ["id", "kind", "name", "source_id", "category", "skill_level", "stat_keys", "search_name"]
    near = named.select(*columns).join(per_document, "id").join(asked, "query_id").filter(_holds()).select(
        F.col("query_id").alias("asked_as"), "id", "kind", "name", "search_name", "m.distance", "m.gap", "m.alias")

    def order():
        return [F.col("distance"), F.col("gap"), F.col("alias"), F.col("kind"),
                code_unit_order(F.col("name")), code_unit_order(F.col("id"))]

    best = near.groupBy("asked_as", "search_name").agg(
        F.min_by(F.struct("id", "kind", "name", "distance", "gap", "alias"), F.struct(*order())).alias("b")
    ).select("asked_as", "b.*")
    rank = F.row_number().over(Window.partitionBy("asked_as").orderBy(*order()))
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= SUGGESTION_LIMIT)
    allowed = F.greatest(F.lit(0), F.least(F.lit(SUGGESTION_LIMIT), F.coalesce(F.col("limit"), F.lit(SUGGESTION_LIMIT))))
    own = told.select("query_id", "asked_as", allowed.alias("_allowed")).join(ranked, "asked_as").filter("rank <= _allowed")
    return own.select("query_id", "rank", "id", "kind", "name", "distance").orderBy("query_id", "rank")


def suggest(documents: DataFrame, queries: list[SearchQuery]) -> DataFrame:
    """Suggestions for a short list of queries; which of them match something is told by one scan."""
    named = documents if "search_name" in documents.columns else with_search_name(documents)
    named = durable(named.select("id", "kind", "name", "source_id", "category", "skill_level", "stat_keys", "aliases", "text", "search_name"))
    answered = matches(named, queries).select("query_id").distinct() if queries else None
    return suggest_table(named, query_table(documents.sparkSession, queries), answered)


# ---- documents --------------------------------------------------------------

def build_documents(entities: DataFrame) -> DataFrame:
    """One search document per entity.

    ``entities`` has ``kind, id, name, slug, description, source_id, category,
    skill_level, aliases, stat_keys`` and ``extra_parts``, the kind's own texts.
    """
    segment_pairs = [F.lit(x) for pair in SEGMENTS.items() for x in pair]
    segment = F.create_map(*segment_pairs)[F.col("kind")]
    skill = F.when(F.col("kind").isin(*CRAFTING_KINDS), F.col("skill_level"))
    aliases = F.sort_array(F.array_distinct("aliases"))
    parts = F.concat(
        F.array("name"), aliases, F.array(F.coalesce("description", F.lit("")), F.col("kind"),
                                          F.coalesce("category", F.lit("")), F.col("source_id")),
        F.when(skill.isNotNull(), F.array(F.concat(F.lit("source skill "), skill.cast("string")))).otherwise(
            F.array().cast("array<string>")),
        F.coalesce("extra_parts", F.array().cast("array<string>")),
    )
    joined = entities.select(
        "id", "kind", "name", aliases.alias("aliases"), F.coalesce("description", F.lit("")).alias("summary"), "source_id",
        "category", F.sort_array(F.array_distinct("stat_keys")).alias("stat_keys"), skill.alias("skill_level"),
        F.concat(F.lit("/"), segment, F.lit("/"), F.col("slug")).alias("url"), F.array_join(parts, " ").alias("text"),
    )
    return joined.withColumn("text", F.lower(nfkc(F.col("text"))))


def document_order() -> list[Column]:
    return [F.col("kind"), code_unit_order(F.col("name")), code_unit_order(F.col("id"))]


def stat_key_rows(uses: DataFrame, stats: DataFrame) -> DataFrame:
    """Search key of each stat an entity uses, distinct per owner.

    ``uses`` has ``owner_id`` and either a linked ``stat_id``, a selector
    (``modifier_kind, source_key``) or a plain ``stat_key``. A linked stat gives
    its key; then a definition with the same selector; then the raw text.
    """
    by_id = stats.select(F.col("id").alias("stat_id"), F.col("canonical_key").alias("_by_id"))
    defined = stats.filter("modifier_kind is not null").groupBy("modifier_kind", "source_key").agg(
        F.max_by("canonical_key", code_unit_order(F.col("canonical_key"))).alias("_by_selector"))
    joined = uses.join(by_id, "stat_id", "left").join(defined, ["modifier_kind", "source_key"], "left")
    raw = F.when(F.col("modifier_kind").isNotNull(), stat_search_key(F.col("modifier_kind"), F.col("source_key"))).otherwise(
        F.col("stat_key"))
    key = F.coalesce("_by_id", "_by_selector", raw)
    return joined.select("owner_id", key.alias("stat_key")).distinct()


# ---- facets -----------------------------------------------------------------

def category_facets(documents: DataFrame, scope: str = "all") -> DataFrame:
    """Distinct categories in their labelled groups, in reading order."""
    kinds = None if scope == "all" else CRAFTING_KINDS if scope == "crafting" else [scope]
    group = rank = label = None
    for position, (group_id, title, members) in enumerate(CATEGORY_GROUPS):
        here = F.col("kind").isin(*members)
        group = F.when(here, group_id) if group is None else group.when(here, group_id)
        label = F.when(here, title) if label is None else label.when(here, title)
        rank = F.when(here, position) if rank is None else rank.when(here, position)
    scoped = documents if kinds is None else documents.filter(F.col("kind").isin(*kinds))
    shown = F.when(F.col("kind") == "item", item_category_label(F.col("category"))).otherwise(
        display_title(F.col("category")))
    options = scoped.filter("category is not null").select(
        rank.alias("group_rank"), group.alias("group_id"), label.alias("group_label"),
        F.col("category").alias("value"), shown.alias("label"),
    ).filter("group_id is not null").distinct()
    return options.orderBy("group_rank", F.collate(F.col("label"), "UNICODE_CI"), F.collate(F.col("value"), "UNICODE"))


def stat_facets(stats: DataFrame, document_stat_keys: DataFrame) -> DataFrame:
    """Distinct stat keys in use, folded onto the definition that knows them by any name."""
    names = F.array(
        F.col("id"), F.col("canonical_key"),
        F.when(F.col("modifier_kind").isNotNull(), stat_search_key(F.col("modifier_kind"), F.col("source_key"))),
    )
    claims = stats.select(
        F.explode(F.filter(names, lambda n: n.isNotNull())).alias("stat_key"), F.col("canonical_key").alias("_value"),
        F.col("name").alias("_label"),
    )
    known = claims.groupBy("stat_key").agg(
        F.max_by(F.struct("_value", "_label"), code_unit_order(F.col("_value"))).alias("_def"))
    used = document_stat_keys.select("stat_key").distinct().join(known, "stat_key", "left")
    value = F.coalesce("_def._value", "stat_key")
    label = F.coalesce("_def._label", facet_label(F.col("stat_key")))
    options = used.select(value.alias("value"), label.alias("label")).groupBy("value").agg(F.min("label").alias("label"))
    return options.orderBy(F.collate(F.col("label"), "UNICODE"), F.collate(F.col("value"), "UNICODE"))


def skill_facet(documents: DataFrame) -> DataFrame:
    return documents.filter("skill_level is not null").select("skill_level").distinct().orderBy("skill_level")


def repair_scope(requests: DataFrame, documents: DataFrame, source_ids: DataFrame, stat_options: DataFrame) -> DataFrame:
    """Facet values that exist, others as ``all``; requests stay one row each.

    A category must be offered under the (repaired) kind; a stat may be given by
    any alias of ``stat_options(value, aliases)``; a skill bound needs a kind
    that has one.
    """
    sources = source_ids.select(F.col("id").alias("source"), F.lit(True).alias("_source")).distinct()
    offered = documents.filter("category is not null").select("kind", "category").distinct()
    groups = F.filter(F.array(
        F.col("kind"), F.lit("all"), F.when(F.col("kind").isin(*CRAFTING_KINDS), F.lit("crafting"))), lambda g: g.isNotNull())
    faceted = [kind for _, _, kinds in CATEGORY_GROUPS for kind in kinds]
    categories = offered.filter(F.col("kind").isin(*faceted)).select(
        F.explode(groups).alias("kind"), "category", F.lit(True).alias("_category")).distinct()
    stats = stat_options.select(F.explode("aliases").alias("stat"), F.col("value").alias("_stat")).groupBy("stat").agg(
        F.min("_stat").alias("_stat"))
    skills = documents.filter("skill_level is not null").select(
        F.col("skill_level").cast("string").alias("skill"), F.lit(True).alias("_skill")).distinct()
    kind = F.when(F.col("kind").isin(*SEGMENTS, "crafting"), F.col("kind")).otherwise("all")
    joined = (
        requests.withColumn("kind", kind).join(sources, "source", "left").join(categories, ["kind", "category"], "left")
        .join(stats, "stat", "left").join(skills, "skill", "left")
    )
    bounded = F.col("_skill") & F.col("kind").isin("all", "crafting", *CRAFTING_KINDS)
    return joined.select(
        "request_id", "kind", F.when(F.col("_source"), F.col("source")).otherwise("all").alias("source"),
        F.when(F.col("_category"), F.col("category")).otherwise("all").alias("category"),
        F.coalesce("_stat", F.lit("all")).alias("stat"), F.when(bounded, F.col("skill")).otherwise("all").alias("skill"),
    )


def name_search(records: DataFrame, text: str) -> DataFrame:
    """Historical name search: a lower-cased substring."""
    return records.filter(F.contains(F.lower("name"), F.lower(F.lit(text))))


def with_aliases(documents: DataFrame, aliases: DataFrame) -> DataFrame:
    """Attach final route aliases, a short list per record."""
    grouped = aliases.groupBy("id").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    return documents.drop("aliases").join(grouped, "id", "left").withColumn(
        "aliases", F.coalesce("aliases", F.array().cast("array<string>")))

