"""Documents and texts: registry, chunks, lookups, checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.more_rules import normalize_context
from ..store import checkpointed, small


def register(docs: DataFrame) -> DataFrame:
    """Status of documents (doc_id, text) by checksum: the first with a content is pending, later ones are skipped."""
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"))
    first = rows.groupBy("checksum").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, "checksum").select("doc_id", "checksum", F.when(F.col("doc_id") == F.col("first_id"), "PENDING").otherwise("SKIPPED").alias("status"))


def fixed_chunks(docs: DataFrame, size: int = 2000) -> DataFrame:
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / size)).cast("int")
    return docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).select("doc_id", "chunk", F.col("text").substr(F.col("chunk") * size + 1, F.lit(size)).alias("text"))


def _paragraphs(text: str, least: int, most: int) -> list[tuple[str, int]]:
    """Blocks of a text with the level that made them: 1 blank lines, 2 lines, 3 sentences, 4 fixed length."""
    blocks: list[str] = []
    for part in (p.strip() for p in text.split("\n\n")):
        if part and blocks and len(part) < least:
            blocks[-1] += "\n" + part
        elif part:
            blocks.append(part)
    if len(blocks) > 1:
        return [(b, 1) for b in blocks]
    for level, pieces in ((2, text.split("\n")), (3, text.replace(". ", ".\x00").split("\x00"))):
        out, held = [], ""
        for piece in filter(None, (p.strip() for p in pieces)):
            if held and len(held) + len(piece) + 1 > most:
                out.append(held)
                held = ""
            held = f"{held} {piece}".strip()
        out += [held] if held else []
        if len(out) > 1 and all(len(x) <= 2 * most for x in out):
            return [(x, level) for x in out]
    return [(text[i : i + most], 4) for i in range(0, len(text), most)]


def paragraphs(docs: DataFrame, least: int = 100, most: int = 2000) -> DataFrame:
    """(doc_id, idx, level, text): packing runs along a document, documents run in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, level, t) for d, text in zip(batch["doc_id"], batch["text"], strict=True) for i, (t, level) in enumerate(_paragraphs(text or "", least, most))]
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "level", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, idx int, level int, text string")


def first_sentences(docs: DataFrame, n: int = 3, most: int = 400) -> DataFrame:
    parts = F.slice(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\u0001"), "\u0001"), 1, n)
    return docs.select("doc_id", F.substring(F.array_join(parts, " "), 1, most).alias("summary"))


def token_estimate(docs: DataFrame) -> DataFrame:
    tokens = F.floor(F.length("text") / 4)
    return docs.select("doc_id", tokens.alias("tokens"), F.when(tokens > 2000, "large").otherwise("small").alias("route"))


def containing_names(names: DataFrame, gram: int = 3, split: int = 20_000) -> DataFrame:
    """All pairs (outer, inner) of different names, lower-cased, of which the first holds the second.

    An index by rarest gram: a name of `gram` letters or more is looked for among the names that have the rarest of its grams, a shorter
    one among those that have it as a gram of its own length. The names with a gram are dealt to parts of about `split`, whatever their
    number; what is looked for meets each part once. Null and empty names are no names; repeated ones are one.
    """
    n = checkpointed(names.select(F.lower("name").alias("name")).filter("name <> ''").distinct())

    def grams(size: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.length("name") - size + 1), lambda i: F.substring("name", i, size))
        return F.when(F.length("name") >= size, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    held = n.select("name", F.explode(F.concat(*[grams(k) for k in range(1, gram + 1)])).alias("gram"))
    often = checkpointed(held.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    own = F.when(F.length("name") >= gram, grams(gram)).otherwise(F.array("name"))
    wanted = n.select(F.col("name").alias("inner"), F.explode(own).alias("gram")).join(often, "gram")
    wanted = checkpointed(wanted.groupBy("inner").agg(F.min(F.struct("n", "gram")).alias("x")).select("inner", "x.gram", F.ceil(F.col("x.n") / split).cast("int").alias("parts")))
    outer = held.join(wanted.select("gram", "parts").distinct(), "gram").select(F.col("name").alias("outer"), "gram", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"))
    inner = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return outer.join(inner, ["gram", "part"]).filter(F.contains("outer", "inner") & (F.col("outer") != F.col("inner"))).select("outer", "inner")


def fuzzy_names(left: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """All pairs a < b of distinct names with edit similarity of at least `least`; names of one letter or more.

    A pair whose longer name has n letters may differ in k = (1 - least) n edits. Cut into k + 1 segments, the longer
    name has one that the shorter holds unchanged, at most k places from where it was: so segments of the
    longer names meet the substrings of the shorter ones at those shifts, and what meets is measured.
    """
    edits = lambda n: F.floor(n * (1 - least) + 1e-9).cast("int")
    cut = lambda i, n, k: F.floor(i * n / (k + 1)).cast("int")

    def spread(names: DataFrame) -> DataFrame:
        """name, n (length of the longer name), k, i (segment), at and size of the segment."""
        rows = names.withColumn("k", edits(F.col("n"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
        rows = rows.withColumn("at", cut(F.col("i"), F.col("n"), F.col("k")))
        return rows.withColumn("size", cut(F.col("i") + 1, F.col("n"), F.col("k")) - F.col("at"))

    names = left.select("name").distinct().filter("name <> ''")
    other = right.select("name").distinct().filter("name <> ''")
    found = []
    for longer, shorter in ((names, other), (other, names)):
        whole = spread(longer.withColumn("n", F.length("name"))).select(F.col("name").alias("x"), "n", "i", F.expr("substring(name, at + 1, size)").alias("part"))
        lengths = F.sequence(F.length("name"), F.floor(F.length("name") / least + 1e-9).cast("int"))
        tried = spread(shorter.withColumn("n", F.explode(lengths))).withColumn("shift", F.explode(F.sequence(-F.col("k"), F.col("k"))))
        tried = tried.withColumn("at", F.col("at") + F.col("shift")).filter((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.length("name")))
        parts = tried.select(F.col("name").alias("y"), "n", "i", F.expr("substring(name, at + 1, size)").alias("part")).distinct()
        found.append(whole.join(parts, ["n", "i", "part"]).select("x", "y"))
    pairs = found[0].select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(found[1].select(F.col("y").alias("a"), F.col("x").alias("b")))
    score = 1.0 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))
    return pairs.filter("a < b").distinct().withColumn("similarity", score).filter(F.col("similarity") >= least - 1e-9)


def hybrid_search(vector: DataFrame, keyword: DataFrame, top: int = 10, least: float = 0.7, page: int = 5) -> DataFrame:
    """Archive search of many queries: query, content, source, score, rank and page.

    vector: (query, content, score), of which the `top` best are taken and then those over `least`; keyword: (query, content, date) of rows that hold
    the query, of which the `top` newest are taken, at a score of 1. Vector hits come first; of a content that comes again the first hit
    stays. Ties are ordered by content.
    """
    first = lambda *by: F.row_number().over(Window.partitionBy("query").orderBy(*by))
    v = vector.withColumn("r", first(F.desc("score"), "content")).filter((F.col("r") <= top) & (F.col("score") > least)).select("query", "content", F.lit("vector").alias("source"), "score", F.lit(0).alias("p"), "r")
    k = keyword.withColumn("r", first(F.desc("date"), "content")).filter(F.col("r") <= top).select("query", "content", F.lit("keyword").alias("source"), F.lit(1.0).alias("score"), F.lit(1).alias("p"), "r")
    one = v.unionByName(k).groupBy("query", "content").agg(F.min(F.struct("p", "r", "source", "score")).alias("x")).select("query", "content", "x.*")
    return one.withColumn("rank", first("p", "r")).select("query", "content", "source", "score", "rank", F.floor((F.col("rank") - 1) / page).alias("page"))


def newest_holding(rows: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """The `top` newest rows (content, date) that hold what each query (query, asked) asks for, ties by content: query, content, date.

    Rows are searched and ranked once for each text that is asked for, not for each query that asks for it; the texts are broadcast.
    """
    asked = small(queries.select("asked").distinct(), 100_000, "queries")
    order = Window.partitionBy("asked").orderBy(F.desc("date"), "content")
    found = rows.join(asked, F.contains("content", "asked")).select("asked", "content", "date").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top)
    return queries.select("query", "asked").join(found, "asked").select("query", "content", "date")


def leak_guard(docs: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Texts without the lines that hold one of some words."""
    hit = lambda line: F.coalesce(line.rlike("|".join(words)), F.lit(False))
    lines = F.filter(F.split("text", "\n"), lambda x: ~hit(x))
    return docs.select("doc_id", F.size(lines).alias("lines"), F.md5(F.array_join(lines, "\n")).alias("digest"))


def pedagogy_check(turns: DataFrame) -> DataFrame:
    """Rule violations of tutor answers (conv_id, turn, text), judged on the text as given, and a score."""
    text = F.lower("text")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    rules = {
        "active_learning": ~text.rlike(r"\?|try|think"), "cognitive_load": words > 120, "scaffolding": ~text.rlike("first|next|step|then"),
        "no_answer": text.rlike("the answer is|solution is"), "growth": text.rlike("wrong|bad|stupid|idiot"), "feedback": words < 5, "personal": ~text.rlike("you"),
    }
    found = F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on in rules.items()]))
    return turns.select("conv_id", "turn", F.array_join(found, ",").alias("violations"), F.round(1 - F.size(found) / len(rules), 6).alias("score"))


def json_object(rows: DataFrame) -> DataFrame:
    """The JSON object inside a free text (first brace to the last), and its score."""
    obj = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    return rows.select("id", F.get_json_object(obj, "$.score").cast("double").alias("score"), F.get_json_object(obj, "$.label").alias("label"))


def judge_score(rows: DataFrame) -> DataFrame:
    """A judge's text as a score in [0, 1]: `10 n` at the start, else the weighted JSON fields, over ten."""
    plain = F.regexp_extract("text", r"^10 (\d+)", 1)
    obj = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    part = lambda k: F.coalesce(F.get_json_object(obj, f"$.{k}").cast("double"), F.lit(0.0))
    mixed = 0.6 * part("accuracy") + 0.2 * part("completeness") + 0.2 * part("clarity")
    score = F.when(plain != "", plain.cast("double")).otherwise(mixed) / 10
    return rows.select("id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6).alias("score"))


def consensus_trace(traces: DataFrame, marker: str = "Student Hint:") -> DataFrame:
    """Of the traces (id, pos, text) of an id, the first with the marker, else the longest; and the hint after it."""
    marked = F.contains("text", F.lit(marker))
    out = traces.groupBy("id").agg(F.min_by(F.when(marked, F.col("text")), F.when(marked, F.col("pos"))).alias("first"), F.max_by("text", F.struct(F.length("text"), -F.col("pos"))).alias("longest"))
    best = F.coalesce("first", "longest")
    return out.select("id", F.when(F.col("first").isNotNull(), F.trim(F.split_part(best, F.lit(marker), F.lit(2)))).otherwise(best).alias("hint"))


def map_domains(inputs: DataFrame, domains: DataFrame, least: float = 0.7) -> DataFrame:
    """The best domain of each input (id, text); domains (key, name, aliases, ordinal) are a list of a few rows."""
    from ..functions.more_rules import domain_score

    rows = inputs.join(small(domains, 1000, "domains")).withColumn("score", domain_score(F.lower(F.trim("text")), F.col("key"), F.col("name"), F.col("aliases")))
    best = rows.groupBy("id").agg(F.max_by(F.struct("key", "score"), F.struct("score", -F.col("ordinal"))).alias("x")).select("id", "x.*")
    return best.select("id", F.when(F.col("score") > 0, F.col("key")).otherwise("general").alias("domain"), "score", (F.col("score") < least).alias("needs_confirmation"))


def _listed(df: DataFrame, most: int, what: str, name: str) -> DataFrame:
    """A list of a few rows, checked, as one row with one array column in the order of `ordinal`."""
    fields = ["ordinal", *[c for c in df.columns if c != "ordinal"]]
    return F.broadcast(small(df, most, what).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name)))


def suggest_domains(texts: DataFrame, domains: DataFrame, least: int = 2) -> DataFrame:
    """(id, domain, score) of each text (id, text): 10 for a domain's code in it, 8 for its name, 2 for each keyword.

    domains (code, display_name, keywords, ordinal) are a list of at most 1 000 rows, which one row carries to
    the texts, so that no text is shuffled. The first of equal domains wins; below `least` there is none (null).
    """
    has = lambda x: F.contains(F.lower("text"), F.lower(x))
    score = lambda d: F.when(has(d["code"]), 10).otherwise(0) + F.when(has(d["display_name"]), 8).otherwise(0) + 2 * F.size(F.filter(d["keywords"], has))
    scored = F.transform("_domains", lambda d: F.struct(F.coalesce(score(d), F.lit(0)).alias("score"), (-d["ordinal"]).alias("first"), d["code"].alias("code")))
    rows = texts.select("id", "text").join(_listed(domains, 1000, "domains", "_domains")).select("id", F.array_max(scored).alias("best"))
    found = F.col("best.score") >= least
    return rows.select("id", F.when(found, F.col("best.code")).alias("domain"), F.when(found, F.col("best.score")).otherwise(0).alias("score"))


def keyword_domains(titles: DataFrame, keywords: DataFrame, default: str = "general") -> DataFrame:
    """(id, domain): the domain of the first keyword, in the order of `ordinal`, that a title (id, title) contains."""
    first = F.get(F.filter("_keywords", lambda k: F.contains(F.lower("title"), k["keyword"])), F.lit(0))["domain"]
    return titles.select("id", "title").join(_listed(keywords, 10_000, "keywords", "_keywords")).select("id", F.coalesce(first, F.lit(default)).alias("domain"))


def resolve_contexts(inputs: DataFrame, registry: DataFrame, most: int = 3) -> DataFrame:
    """(id, key, context_key, suggestions, needs_refine) of raw contexts (id, domain, context).

    registry: (domain, context_key, aliases, ordinal), at most 100 000 rows. A key or an alias that equals the
    normalised context is its context_key; else up to `most` keys of the domain are suggested, in the order of
    `ordinal`: those that start with the same three letters or contain one of its words. Each
    distinct key of a domain is compared once.
    """
    key, words, _ = normalize_context(F.col("context"))
    rows = inputs.select("id", "domain", key.alias("key"), (words == 1).alias("needs_refine"))
    near = F.startswith("context_key", F.substring("key", 1, 3)) | F.exists(F.split("key", "_"), lambda w: F.contains("context_key", w))
    hit = (F.col("key") == F.col("context_key")) | F.coalesce(F.array_contains("aliases", F.col("key")), F.lit(False))
    entry = F.struct("ordinal", "context_key")
    met = rows.select("domain", "key").distinct().join(small(registry, 100_000, "registered contexts"), "domain")
    found = met.groupBy("domain", "key").agg(F.min(F.when(hit, entry)).alias("hit"), F.slice(F.array_sort(F.collect_list(F.when(near, entry))), 1, most).alias("near"))
    near_keys = F.when(F.col("hit").isNull(), F.array_join("near.context_key", ",")).otherwise("")
    return rows.join(found, ["domain", "key"], "left").select("id", "key", F.col("hit.context_key").alias("context_key"), F.coalesce(near_keys, F.lit("")).alias("suggestions"), "needs_refine")


def apply_context_actions(aliases: DataFrame, actions: DataFrame) -> DataFrame:
    """Aliases (alias, key) after review: approved ones move to the action's key, rejected and deprecated ones go."""
    rows = aliases.join(actions.select("alias", "action", F.col("key").alias("to_key")), "alias", "left")
    return rows.filter("action is null or action = 'approve'").select("alias", F.when(F.col("action") == "approve", F.col("to_key")).otherwise(F.col("key")).alias("key"))


def tree_sections(nodes: DataFrame) -> DataFrame:
    """Sections (doc_id, node, path, pos) in depth-first order, from rows (doc_id, node, parent, title); roots have no parent.

    As many rounds as the deepest tree has levels. Nodes that no root reaches (their parent is missing, or they lie
    on a loop) are in no section.
    """
    nodes = checkpointed(nodes.select("doc_id", "node", "parent", "title"))
    level = nodes.filter("parent is null").select("doc_id", "node", F.array("node").alias("sort"), F.col("title").alias("path"))
    child = nodes.filter("parent is not null").select("doc_id", F.col("node").alias("c"), F.col("parent").alias("node"), "title")
    out = level
    while True:
        level = level.join(child, ["doc_id", "node"]).select("doc_id", F.col("c").alias("node"), F.concat("sort", F.array("c")).alias("sort"), F.concat_ws(" > ", "path", "title").alias("path"))
        level = checkpointed(level)
        if not level.head(1):
            break
        out = out.unionAll(level)
    order = Window.partitionBy("doc_id").orderBy("sort")  # numbers, from the root down
    return out.select("doc_id", "node", "path", F.row_number().over(order).alias("pos"))


def locate_sections(docs: DataFrame, starts: DataFrame) -> DataFrame:
    """Character ranges of sections (doc_id, pos, start_text) in their documents: exactly, else by the first five words in any case.

    A section ends where the next one that was found begins, and the last at the end of the text.
    """
    five = F.array_join(F.slice(F.split(F.lower("start_text"), " "), 1, 5), " ")
    rows = starts.join(docs.select("doc_id", "text"), "doc_id")
    exact = F.instr("text", F.col("start_text"))
    at = F.when(exact > 0, exact).otherwise(F.instr(F.lower("text"), five))
    rows = rows.select("doc_id", "pos", at.alias("start"), F.length("text").alias("n")).filter(F.col("start") > 0)
    end = F.coalesce(F.lead("start").over(Window.partitionBy("doc_id").orderBy("pos")) - 1, F.col("n"))
    return rows.select("doc_id", "pos", "start", end.alias("end"))


def misconceptions(answers: DataFrame, catalogue: DataFrame, least: float = 0.65) -> DataFrame:
    """Catalogue entries (concept_id, category, kind, description) that an answer (id, concept_id, category, text) resembles.

    An answer to a concept without any entry gets one of kind `unknown_conceptual` if its category is CONCEPTUAL. Each text of a concept and
    category is held against each description once, however many answers and entries have it, and only where their lengths allow the similarity.
    """
    from ..functions.rules import edit_similarity

    of = ["concept_id", "category"]
    lengths = [F.length(F.trim(F.lower(c))) for c in ("text", "description")]
    texts, described = answers.select(*of, "text").distinct(), catalogue.select(*of, "description").distinct()
    near = texts.repartition(*of, "text").join(described, of).filter(F.least(*lengths) >= (least - 1e-9) * F.greatest(*lengths)).withColumn("confidence", edit_similarity(F.col("text"), F.col("description")))
    near = checkpointed(near.filter(F.col("confidence") >= least))
    rows = answers.join(near.join(catalogue, [*of, "description"]), [*of, "text"])
    found = rows.select("id", "kind", F.when(F.col("category") == "CONCEPTUAL", "HIGH").otherwise("MEDIUM").alias("severity"), "confidence")
    bare = answers.filter("category = 'CONCEPTUAL'").join(catalogue.select("concept_id").distinct(), "concept_id", "left_anti")
    return found.unionByName(bare.select("id", F.lit("unknown_conceptual").alias("kind"), F.lit("HIGH").alias("severity"), F.lit(0.6).alias("confidence")))
