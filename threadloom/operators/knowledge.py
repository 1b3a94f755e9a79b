"""Documents in revisions: chunks, search by words and vectors, and which results count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_terms
from ..functions.vectors import dot
from ..storage import Steps

#: Okapi parameters, and the constant of reciprocal ranks.
K1, B, RRF = 1.2, 0.75, 60
MAX_TOKENS, OVERLAP = 180, 30
POOL, DEEP = 20, 40

# What is a heading, a question of a FAQ, and a page mark.
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
ASKS = r"(?iU)^(?:(?:Q(?:uestion)?|P(?:regunta)?)\s*[:：]|[^.!?。！？]{2,120}[?？])"
PAGE = r"\[Page (\d+)\]"

_SPACE = r"[\s\x1c-\x1f]"


def chunk(revisions: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """A row for each chunk of revisions (revision_id, source_type, content): chunk_id, section, parent_heading, page, ordinal, token_count, text.

    Blocks are what blank lines separate. A block belongs to the last heading before it, and under those of lower levels that still hold there. In a FAQ a
    question goes with the block after it. Units of more than max_tokens words come in overlapping pieces. A text without blocks of its own is one chunk.
    """
    strip = lambda c: F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")
    whole = revisions.select("revision_id", F.coalesce(F.col("source_type") == "faq", F.lit(False)).alias("faq"), F.coalesce("content", F.lit("")).alias("content"))
    # a last row stands for the text itself, and counts where no other block does
    texts = F.concat(F.transform(F.split("content", r"(?U)\n\s*\n"), strip), F.array(strip(F.col("content"))))
    rows = whole.select("revision_id", "faq", F.size(texts).alias("n"), F.posexplode(texts).alias("pos", "text")).withColumn("end", F.col("pos") == F.col("n") - 1).where("text != '' OR end")
    level = F.when(~F.col("end"), F.length(F.regexp_extract("text", HEADING, 1)))
    rows = rows.withColumns({"level": F.when(level > 0, level), "name": F.regexp_extract("text", HEADING, 2)})
    so_far = Window.partitionBy("revision_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = {k: F.last(F.when(F.col("level") == k, F.struct("pos", "name")), ignorenulls=True).over(so_far) for k in range(1, 7)}
    rows = rows.withColumns({f"h{k}": v for k, v in last.items()} | {"section": F.last(F.when(F.col("level").isNotNull(), F.col("name")), ignorenulls=True).over(so_far), "part": F.count("level").over(so_far)})
    holds = [F.when(F.col(f"h{k}.pos") > F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(f"h{j}.pos", F.lit(-1)) for j in range(1, k)]), F.col(f"h{k}.name")) for k in range(1, 7)]
    trail = F.array_join(F.array_compact(F.array(*holds)), " > ")
    everything = Window.partitionBy("revision_id")
    rows = rows.withColumns({"parent_heading": F.when(trail != "", trail), "body": F.col("level").isNull() & ~F.col("end")})
    rows = rows.withColumn("bodies", F.count_if("body").over(everything)).where(F.col("body") | (F.col("end") & (F.col("bodies") == 0)))
    # of neighbouring questions every other one, from the first on, takes the block after it
    section = Window.partitionBy("revision_id", "part").orderBy("pos")
    asks = F.col("faq") & F.col("text").rlike(ASKS)
    rows = rows.withColumns({"asks": asks, "nth": F.row_number().over(section), "next": F.lead("text").over(section)})
    rows = rows.withColumn("run", F.col("nth") - F.row_number().over(Window.partitionBy("revision_id", "part", "asks").orderBy("pos")))
    rows = rows.withColumn("odd", F.col("asks") & (F.row_number().over(Window.partitionBy("revision_id", "part", "asks", "run").orderBy("pos")) % 2 == 1))
    rows = rows.withColumn("taken", F.coalesce(F.lag("odd").over(section), F.lit(False))).where(~F.col("taken"))
    rows = rows.withColumn("text", F.when(F.col("odd") & F.col("next").isNotNull(), F.concat("text", F.lit("\n\n"), "next")).otherwise(F.col("text")))
    words = lambda c: F.filter(F.split(c, rf"(?U){_SPACE}+"), lambda w: w != "")
    step = max(1, max_tokens - overlap)
    cut = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step)), lambda i: F.array_join(F.slice("w", i + 1, max_tokens), " "))
    pieces = rows.withColumn("w", words("text")).withColumn("pieces", F.when(F.size("w") <= max_tokens, F.array("text")).otherwise(cut))
    out = pieces.select("revision_id", "section", "parent_heading", "pos", F.posexplode("pieces").alias("piece", "text"))
    page = F.regexp_extract("text", PAGE, 1)
    out = out.select("revision_id", "section", "parent_heading", F.when(page != "", page.cast("int")).alias("page"), (F.row_number().over(Window.partitionBy("revision_id").orderBy("pos", "piece")) - 1).alias("ordinal"), F.size(words("text")).alias("token_count"), "text")
    return out.withColumn("chunk_id", F.concat_ws(":", F.col("revision_id").cast("string"), F.col("ordinal").cast("string")))


def window_chunks(texts: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, id_: str = "revision_id") -> DataFrame:
    """Overlapping pieces of words of texts without structure, in the JVM."""
    step = max(1, max_tokens - overlap)
    words = F.filter(F.split("content", r"\s+"), lambda w: w != "")
    rows = texts.select(id_, words.alias("w")).where(F.size("w") > 0)
    last = F.when(F.size("w") <= max_tokens, 0).otherwise(F.floor((F.size("w") - 1) / step).cast("int"))
    rows = rows.select(id_, "w", F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    piece = F.slice("w", F.col("ordinal") * step + 1, max_tokens)
    return rows.select(id_, "ordinal", F.size(piece).alias("token_count"), F.array_join(piece, " ").alias("text"))


def postings(chunks: DataFrame, terms: Column | None = None) -> DataFrame:
    """(term, chunk_id, tf, length): the inverted index. Terms keep their repeats here, so that frequency counts."""
    words = terms if terms is not None else F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), 1)
    rows = chunks.select("chunk_id", words.alias("t")).withColumn("length", F.size("t"))
    return rows.select("chunk_id", "length", F.explode("t").alias("term")).groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def postings_of(chunks: DataFrame, terms: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """(index, totals) for bm25() of chunks (chunk_id, words): postings of the terms (term) alone, and one row (chunks, tokens) over all chunks.

    Texts are split once: what is written has a row for each posting, and one for each chunk that says how long it is.
    """
    wanted = terms.select("term").distinct().withColumn("wanted", F.lit(True))
    each = chunks.select("chunk_id", F.size("words").alias("length"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "words")).alias("term"))
    kept = each.join(wanted, "term", "left").where("term IS NULL OR wanted")
    kept = steps.cut(kept.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length")))
    totals = kept.where("term IS NULL").agg(F.count(F.lit(1)).alias("chunks"), F.sum("length").alias("tokens"))
    return kept.where("term IS NOT NULL"), totals


def bm25(index: DataFrame, totals: DataFrame, queries: DataFrame, k: int = DEEP) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of each query by Okapi's weights, ties by id.

    index comes from postings(); totals is one row (chunks, tokens); queries has query_id and term. Only postings of the queries' terms move.
    """
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = queries.select("query_id", "term").distinct().join(df, "term")
    hit = index.join(terms, "term").crossJoin(F.broadcast(totals.select(F.col("chunks"), (F.col("tokens") / F.col("chunks")).alias("mean"))))
    idf = F.log((F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return top_k(hit.groupBy("query_id", "chunk_id").agg(F.sum(weight).alias("score")), k)


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), id_: str = "chunk_id", digits: int = 9) -> DataFrame:
    """The k rows of the highest score within by, with rank; scores tie when equal to so many digits, then the id decides. Spark's window group limit drops the rest
    before the shuffle."""
    rows = scored.withColumn("score", F.round("score", digits))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), id_)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = DEEP, id_: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """(query_id, id, score, rank): the k vectors of the largest product with each query's. queries is a stated set (query_id, query_vector), which meets
    every vector; Spark broadcasts it as far as its size allows, and only k rows a query and task are shuffled."""
    pairs = vectors.select(id_, vector).join(queries.select("query_id", "query_vector"), F.lit(True))
    return top_k(pairs.select("query_id", id_, dot(F.col(vector), F.col("query_vector")).alias("score")), k, id_=id_)


def fuse(rankings: list[DataFrame], limit: int | None = None, id_: str = "chunk_id") -> DataFrame:
    """(query_id, id, rrf, channels): sums of reciprocal ranks over rankings, of the first `limit` of each."""
    cut = [r.where(F.col("rank") <= limit) if limit else r for r in rankings]
    rows = cut[0].select("query_id", id_, "rank")
    for r in cut[1:]:
        rows = rows.unionByName(r.select("query_id", id_, "rank"))
    return rows.groupBy("query_id", id_).agg(F.sum(1 / (F.lit(RRF) + F.col("rank"))).alias("rrf"), F.count(F.lit(1)).alias("channels"))


def temporal_state(when: Column, effective_from: Column, effective_until: Column, published_at: Column, superseded_at: Column) -> Column:
    """future, inactive or active at a time; bounds that are null don't bind."""
    late = lambda c: F.coalesce(when < c, F.lit(False))
    over = lambda c: F.coalesce(when >= c, F.lit(False))
    return F.when(late(effective_from) | late(published_at), "future").when(over(effective_until) | over(superseded_at), "inactive").otherwise("active")


def demote_historical(state: Column, status: Column, provenance: Column) -> Column:
    """For questions about the present: an active source confirmed as historical is inactive."""
    confirmed = (status == "historical") & F.get_json_object(provenance, "$.validity").isin("source-provided", "human-confirmed")
    return F.when((state == "active") & F.coalesce(confirmed, F.lit(False)), "inactive").otherwise(state)


def term_coverage(query_terms: Column, text: Column) -> Column:
    """Share of a query's terms that a text has."""
    return F.size(F.array_intersect(query_terms, search_terms(text))) / F.greatest(F.lit(1), F.size(query_terms))


def select_candidates(candidates: DataFrame, k: int) -> DataFrame:
    """(…, place): eligible candidates of each query, active before inactive, each by rrf and id; an inactive one that both channels found and that
    beats the best active one comes first. candidates has query_id, chunk_id, rrf, channels, official_status, status, temporal_state."""
    ok = candidates.where((F.col("official_status") == "verified_official") & ~F.col("status").isin("draft", "unknown") & (F.col("temporal_state") != "future"))
    by = Window.partitionBy("query_id")
    active = F.col("temporal_state") == "active"
    strong = ~active & (F.col("channels") == 2)
    best = F.max(F.when(active, F.col("rrf"))).over(by)
    rows = ok.withColumn("best", best).withColumn("top", F.max(F.when(strong, F.col("rrf"))).over(by))
    lead = strong & (F.col("rrf") == F.col("top")) & (F.col("rrf") > F.col("best"))
    rows = rows.withColumn("lead_id", F.min(F.when(lead, F.col("chunk_id"))).over(by))
    order = by.orderBy((~F.coalesce(F.col("chunk_id") == F.col("lead_id"), F.lit(False))).cast("int"), (~active).cast("int"), F.desc("rrf"), "chunk_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("best", "top", "lead_id")


def diversify(current: DataFrame, deeper: DataFrame, limit: int = POOL) -> DataFrame:
    """current (query_id, chunk_id, source_id, place), in which the last item of a source with more than half of a full pool gives its place to deeper's first item of
    a source that the pool lacks. Ties between sources fall to the one that comes first."""
    cut = current.where(F.col("place") <= limit).select("query_id", "chunk_id", "source_id", "place")
    by_source = cut.groupBy("query_id", "source_id").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"), F.min("place").alias("first"))
    dominant = by_source.groupBy("query_id").agg(F.sum("n").alias("total"), F.max(F.struct("n", -F.col("first"), "last")).alias("d")).where((F.col("total") >= limit) & (F.col("d.n") > limit // 2)).select("query_id", F.col("d.last").alias("drop"))
    unseen = deeper.select("query_id", "chunk_id", "source_id", "place").join(by_source.select("query_id", "source_id"), ["query_id", "source_id"], "left_anti")
    new = unseen.groupBy("query_id").agg(F.min(F.struct("place", "chunk_id", "source_id")).alias("r"))
    swap = dominant.join(new, "query_id").select("query_id", F.col("drop").alias("place"), F.col("r.chunk_id").alias("new_chunk"), F.col("r.source_id").alias("new_source"))
    out = cut.join(swap, ["query_id", "place"], "left")
    return out.select("query_id", "place", F.coalesce("new_chunk", "chunk_id").alias("chunk_id"), F.coalesce("new_source", "source_id").alias("source_id"))


def neighbor_context(hits: DataFrame, chunks: DataFrame, neighbors: int = 1, max_chars: int = 2000) -> DataFrame:
    """(query_id, hit_id, chunk_id, ordinal, text): each hit with the chunks beside it in its revision, cut to max_chars in all; the hit has the first claim, then lower ordinals."""
    h = hits.select("query_id", F.col("chunk_id").alias("hit_id"))
    spot = h.join(chunks.select(F.col("chunk_id").alias("hit_id"), F.col("revision_id").alias("r"), F.col("ordinal").alias("o")), "hit_id")
    near = spot.select("query_id", "hit_id", "r", "o", F.explode(F.sequence(F.greatest(F.col("o") - neighbors, F.lit(0)), F.col("o") + neighbors)).alias("ordinal"))
    rows = near.join(chunks.select(F.col("revision_id").alias("r"), "ordinal", "chunk_id", "text"), ["r", "ordinal"])
    order = Window.partitionBy("query_id", "hit_id").orderBy((F.col("chunk_id") != F.col("hit_id")).cast("int"), "ordinal")
    before = F.coalesce(F.sum(F.char_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("left", F.lit(max_chars) - before).where(F.col("left") > 0)
    return rows.select("query_id", "hit_id", "chunk_id", "ordinal", F.substr("text", F.lit(1), F.col("left").cast("int")).alias("text"))


def versions(revisions: DataFrame) -> DataFrame:
    """revisions (source_id, content_hash, effective_from) as versions: repeats of a content are dropped, the first stays; superseded_at is when the next begins."""
    firsts = revisions.groupBy("source_id", "content_hash").agg(F.min("effective_from").alias("effective_from"))
    order = Window.partitionBy("source_id").orderBy("effective_from", "content_hash")
    return firsts.withColumn("version", F.row_number().over(order)).withColumn("superseded_at", F.lead("effective_from").over(order)).withColumn("status", F.when(F.col("superseded_at").isNull(), "active").otherwise("superseded"))


def add_revisions(revisions: DataFrame, arrivals: DataFrame) -> DataFrame:
    """revisions and what arrivals add: (source_id, version, content_hash, status, effective_from, superseded_at).

    arrivals: source_id, content, status, effective_from and arrived, the order in which they come. A content that its source has had already, or that
    comes again, adds nothing. Each new revision has the next version, and ends its predecessor: that one becomes superseded when the new one takes effect.
    """
    new = arrivals.select("source_id", F.sha2("content", 256).alias("content_hash"), "status", "effective_from", "arrived")
    new = new.groupBy("source_id", "content_hash").agg(F.min_by(F.struct("status", "effective_from"), "arrived").alias("r"), F.min("arrived").alias("arrived"))
    new = new.join(revisions.select("source_id", "content_hash").distinct(), ["source_id", "content_hash"], "left_anti")
    known = revisions.groupBy("source_id").agg(F.max("version").alias("last"))
    by = Window.partitionBy("source_id").orderBy("arrived", "content_hash")
    new = new.join(known, "source_id", "left").select("source_id", (F.coalesce("last", F.lit(0)) + F.row_number().over(by)).cast("long").alias("version"), "content_hash", "r.status", "r.effective_from", F.lit(None).cast("timestamp").alias("superseded_at"))
    every = revisions.select("source_id", F.col("version").cast("long").alias("version"), "content_hash", "status", "effective_from", "superseded_at").unionByName(new)
    following = F.lead("effective_from").over(Window.partitionBy("source_id").orderBy("version"))
    ended = F.lead("version").over(Window.partitionBy("source_id").orderBy("version")).isNotNull()
    return every.withColumn("superseded_at", F.when(ended, following).otherwise(F.col("superseded_at"))).withColumn("status", F.when(ended, "superseded").otherwise(F.col("status")))


def reindexable(revisions: DataFrame, chunks: DataFrame, index_version: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(revisions to index anew, refusals (revision_id, problem)): of revisions whose index_version differs, those whose content still has its hash and gives the same
    chunks as are stored (ordinal, text, section)."""
    old = revisions.where(F.col("index_version") != index_version)
    changed = old.where(F.sha2("content", 256) != F.col("content_hash")).select("revision_id", F.lit("content_hash_mismatch").alias("problem"))
    pieces = F.array_sort(F.collect_list(F.struct("ordinal", "text", "section")))
    again = chunk(old, max_tokens, overlap).groupBy("revision_id").agg(pieces.alias("now"))
    stored = chunks.groupBy("revision_id").agg(pieces.alias("then"))
    moved = again.join(stored, "revision_id", "left").where(~F.col("now").eqNullSafe(F.col("then"))).select("revision_id", F.lit("chunks_changed").alias("problem"))
    refused = changed.unionByName(moved.join(changed, "revision_id", "left_anti"))
    return old.join(refused, "revision_id", "left_anti").select("revision_id", F.lit(index_version).alias("index_version")), refused


def next_version(revisions: DataFrame) -> DataFrame:
    """(source_id, next_version)."""
    return revisions.groupBy("source_id").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def missing_embeddings(chunks: DataFrame, cache: DataFrame, title: Column) -> DataFrame:
    """Chunks whose retrieval text isn't in the cache (content_hash) yet; equal texts once."""
    head = F.coalesce("parent_heading", "section")
    text = F.concat(F.lit("Title: "), title, F.lit("\n"), F.when(head.isNotNull(), F.concat(F.lit("Heading: "), head, F.lit("\n"))).otherwise(""), F.lit("\n"), F.col("text"))
    rows = chunks.select(F.sha2(F.concat(F.lit("title-heading-body-v1\n"), text), 256).alias("content_hash"), text.alias("retrieval_text"))
    return rows.join(cache.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])


def valid_ranking(ranking: list, candidates: list[str]) -> list[str] | None:
    """A reranker's answer if it is a permutation of the candidates, else None: the fused order then stands."""
    if not isinstance(ranking, list) or any(not isinstance(x, str) for x in ranking) or len(ranking) != len(candidates) or set(ranking) != set(candidates):
        return None
    return ranking


def _flat(text: str) -> Column:
    """White space collapsed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def quotes_found(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """quotes (chunk_id, quote) with found: whether the quote, white space collapsed, is in the chunk's text and isn't blank."""
    rows = quotes.join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    ok = (_flat("quote") != "") & _flat("text").contains(_flat("quote"))
    return rows.withColumn("found", F.coalesce(ok, F.lit(False))).drop("text")


def quotes_in_all(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every quote (…, quote) with every chunk (…, text), and found as in quotes_found. White space is collapsed once a row; quotes over Spark's size for broadcasts meet the chunks in blocks of partitions."""
    q, c = (Steps(chunks.sparkSession, "quotes").cut(df.withColumn(n, _flat(n))) for df, n in ((quotes, "quote"), (chunks, "text")))
    ok = (F.col("quote") != "") & F.col("text").contains(F.col("quote"))
    return c.crossJoin(q).withColumn("found", F.coalesce(ok, F.lit(False))).drop("text", "quote")


def answer_status(requirements: DataFrame, claims: DataFrame) -> DataFrame:
    """(query_id, answer_status) from requirements (query_id, requirement_id, status) and claims (query_id, requirement_id, source_id, temporal_state, found).

    A claim counts if its quote is found. Evidence of a requirement is active, or inactive if all of it is; a conflict needs two active sources."""
    valid = claims.groupBy("query_id").agg(F.coalesce(F.bool_and("found"), F.lit(True)).alias("valid"))
    per = claims.where("found").groupBy("query_id", "requirement_id").agg(F.count_if(F.col("temporal_state") == "active").alias("a"), F.count_if(F.col("temporal_state") == "inactive").alias("i"), F.count_distinct(F.when(F.col("temporal_state") == "active", F.col("source_id"))).alias("s"))
    r = requirements.join(per, ["query_id", "requirement_id"], "left").fillna(0, ["a", "i", "s"])
    supported = (F.col("a") > 0) | (F.col("i") > 0)
    conflict = F.col("status") == "conflict"
    q = r.groupBy("query_id").agg(F.bool_or(conflict).alias("conflicts"), F.bool_and(~conflict | (F.col("s") >= 2)).alias("proven"), F.bool_or((F.col("status") == "unsupported") | ~supported).alias("missing"), F.bool_and(F.col("a") > 0).alias("all_active"), F.bool_or(F.col("a") > 0).alias("any_active"))
    q = q.join(valid, "query_id", "left")
    status = (
        F.when(~F.coalesce("valid", F.lit(True)), "insufficient_evidence").when(F.col("conflicts") & F.col("proven"), "conflict").when(F.col("missing") | F.col("conflicts"), "insufficient_evidence")
        .when(F.col("all_active"), "grounded").when(~F.col("any_active"), "outdated_only").otherwise("insufficient_evidence")
    )
    return q.select("query_id", status.alias("answer_status"))
