"""Reply forests: edges, roots, episodes and the answers that questions may have had."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_question, normalize
from ..storage import Steps

_COLUMNS = ("message_id", "community_id", "user_id_hash", "user_role", "timestamp", "reply_to_message_id", "campaign_id")


def with_question(messages: DataFrame) -> DataFrame:
    """messages with norm and asks; computed once for all that looks at texts."""
    return messages.withColumn("norm", normalize(F.col("text"))).withColumn("asks", is_question(F.col("norm")))


def reply_edges(messages: DataFrame) -> DataFrame:
    """A row for each reply whose parent is there: columns of the child, and of the parent with p_ before."""
    parent = messages.select(*[F.col(c).alias(f"p_{c}") for c in messages.columns])
    return messages.where(F.col("reply_to_message_id").isNotNull()).join(parent, F.col("reply_to_message_id") == F.col("p_message_id"))


def classified_edges(messages: DataFrame) -> DataFrame:
    """Edges as self (a user replies to their own message), user_to_user, user_to_moderator or other."""
    e = reply_edges(messages)
    users = (F.col("user_role") == "user") & (F.col("p_user_role") == "user")
    same = F.col("user_id_hash") == F.col("p_user_id_hash")
    kind = F.when(users & same, "self").when(users, "user_to_user").when((F.col("p_user_role") == "user") & (F.col("user_role") == "moderator"), "user_to_moderator").otherwise("other")
    return e.withColumn("edge", kind)


def roots(messages: DataFrame) -> DataFrame:
    """(message_id, root_id, depth): the root of each message's thread and its distance from there plus 1.

    Each round doubles how far a message looks up, so rounds grow with the logarithm of a thread's depth. A reply to a message that
    isn't there is a root. Messages that reach no root, as they are on a cycle of replies or below one, are left out: of all others that are still open
    the one nearest to its root is placed in the next round, so a round that places none is the last. Of rows with one id the least parent counts.
    """
    steps = Steps(messages.sparkSession, "roots")
    rows = messages.groupBy("message_id").agg(F.min("reply_to_message_id").alias("p"))
    known = rows.select(F.col("message_id").alias("p"))
    state = rows.join(known, "p", "left_semi").select("message_id", F.col("p").alias("up"), F.lit(1).cast("long").alias("dist"))
    tops = rows.select("message_id").join(state, "message_id", "left_anti").select("message_id", F.col("message_id").alias("up"), F.lit(0).cast("long").alias("dist"))
    done, open_ = steps.cut(tops), steps.cut(state)
    while open_.limit(1).count():
        top = done.select(F.col("message_id").alias("up"), F.col("up").alias("top"), F.col("dist").alias("more"))
        hit = open_.join(top, "up").select("message_id", F.col("top").alias("up"), (F.col("dist") + F.col("more")).alias("dist"))
        higher = open_.select(F.col("message_id").alias("up"), F.col("up").alias("next"), F.col("dist").alias("more"))
        far = open_.join(higher, "up").select("message_id", F.col("next").alias("up"), (F.col("dist") + F.col("more")).alias("dist"))
        found = steps.cut(hit)
        if not found.limit(1).count():
            break
        open_ = steps.cut(far)
        done = done.unionByName(found)
    return done.select("message_id", F.col("up").alias("root_id"), (F.col("dist") + 1).alias("depth"))


def candidate_answers(messages: DataFrame) -> DataFrame:
    """(question_id, answer_id): replies that may answer a question, by structure.

    From a question's replies: a bot's ends the search there; another question or the asker's own is passed through to its replies;
    any other is a candidate, and the search ends there. One round for each level of a thread.
    """
    steps = Steps(messages.sparkSession, "answers")
    asked = messages if "asks" in messages.columns else with_question(messages)
    nodes = steps.cut(asked.select("message_id", "user_id_hash", "user_role", "asks", "reply_to_message_id"))
    replies = nodes.where(F.col("reply_to_message_id").isNotNull() & (F.col("user_role") != "bot")).withColumnRenamed("reply_to_message_id", "at")
    front = nodes.where("asks").select(F.col("message_id").alias("question_id"), F.col("user_id_hash").alias("asker"), F.col("message_id").alias("at"))
    found = None
    while True:
        level = steps.cut(front.join(replies, "at").select("question_id", "asker", "message_id", (F.col("asks") | (F.col("user_id_hash") == F.col("asker"))).alias("through")))
        hit = level.where(~F.col("through")).select("question_id", F.col("message_id").alias("answer_id"))
        found = hit if found is None else found.unionByName(hit)
        front = level.where("through").select("question_id", "asker", F.col("message_id").alias("at"))
        if not front.limit(1).count():
            return found


def episodes(messages: DataFrame) -> DataFrame:
    """A row for each thread: depth, branching, participants, roles, kinds of edges, duration, first response, questions answered and not."""
    m = messages if "asks" in messages.columns else with_question(messages)
    placed = m.drop("text", "norm").join(roots(m), "message_id")
    root = placed.where(F.col("message_id") == F.col("root_id")).select("root_id", F.col("community_id").alias("community_id"), F.col("timestamp").alias("root_time"))
    children = placed.where(F.col("depth") > 1).groupBy("root_id", "reply_to_message_id").agg(F.count(F.lit(1)).alias("n")).groupBy("root_id").agg(F.avg("n").alias("branching"))
    edges = classified_edges(m.drop("text", "norm")).select("message_id", "edge")
    answered = candidate_answers(m).select(F.col("question_id").alias("message_id")).distinct().withColumn("answered", F.lit(True))
    rows = placed.join(edges, "message_id", "left").join(answered, "message_id", "left")
    reply = (F.col("user_role") != "bot") & (F.col("depth") > 1)
    edge = lambda k: F.count_if(F.col("edge") == k)
    out = rows.groupBy("root_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.max("depth").alias("conversation_depth"), F.count_distinct(F.when(F.col("user_role") != "bot", F.col("user_id_hash"))).alias("participants"),
        F.count_if(F.col("user_role") == "user").alias("user_messages"), F.count_if(F.col("user_role") == "moderator").alias("moderator_messages"), edge("self").alias("self_replies"), edge("user_to_user").alias("user_replies"), edge("user_to_moderator").alias("moderator_replies"),
        F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.min(F.when(reply, F.col("timestamp"))).alias("first_reply"),
        F.count_if(F.col("asks")).alias("questions"), F.count_if(F.col("asks") & F.coalesce("answered", F.lit(False))).alias("answered_questions"),
    )
    out = out.join(root, "root_id").join(children, "root_id", "left")
    seconds = lambda a, b: F.timestamp_diff("MICROSECOND", a, b) / 1e6
    return out.select("root_id", "community_id", "message_count", "conversation_depth", F.coalesce("branching", F.lit(0.0)).alias("branching_factor"), "participants", "user_messages", "moderator_messages", "self_replies", "user_replies", "moderator_replies",
                      seconds(F.col("start_time"), F.col("end_time")).alias("duration_seconds"), seconds(F.col("root_time"), F.col("first_reply")).alias("first_response_seconds"), "questions", "answered_questions")


def question_support(messages: DataFrame, by: tuple[str, ...] = ("community_id",)) -> DataFrame:
    """Per group: users' questions, unanswered ones, and answered ones whose first candidate comes from another user."""
    m = messages if "asks" in messages.columns else with_question(messages)
    who = m.select(F.col("message_id").alias("answer_id"), F.col("user_role").alias("a_role"), F.col("user_id_hash").alias("a_user"), F.col("timestamp").alias("a_time"))
    first = candidate_answers(m).join(who, "answer_id").groupBy("question_id").agg(F.min(F.struct("a_time", "answer_id", "a_role", "a_user")).alias("f"))
    asked = m.where(F.col("asks") & (F.col("user_role") == "user")).join(first, F.col("message_id") == F.col("question_id"), "left")
    peer = (F.col("f.a_role") == "user") & (F.col("f.a_user") != F.col("user_id_hash"))
    return asked.groupBy(*by).agg(F.count(F.lit(1)).alias("user_questions"), F.count_if(F.col("f").isNull()).alias("unanswered"), F.count_if(F.col("f").isNotNull()).alias("answered"), F.count_if(peer).alias("peer_first"))
