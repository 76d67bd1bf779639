"""Labelling and retention of conversation tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeoff import constants as C
from takeoff.functions import names, rules
from takeoff.operators.text import found


def intent(text: Column, change_length: int = 30, question_length: int = 20) -> Column:
    """First intent whose rule fits, 'general' when none does; changes and short questions are told in less than so many characters."""
    w = {k: rules.contains_any(text, v) for k, v in C.INTENT_WORDS.items()}
    zone = rules.contains_any(text, C.ZONE_WORDS)
    simple = ["check_data", "search_data", "knowledge_query", "predict", "train", "explain_term", "list_models",
              "find_similar", "cost_breakdown", "greeting", "thanks", "help"]
    branches = [(w[k], F.lit(k)) for k in simple] + [
        (text.rlike(C.AREA_MENTION) & w["building_action"], F.lit("predict")),
        (zone | (w["region_question"] & rules.contains_any(text, C.TALK_CITIES)), F.lit("region_refine")),
        (w["feedback"], F.lit("feedback")),
        (w["supplement"], F.lit("supplement")),
        (w["repredict"], F.lit("repredict")),
        (w["compare"] | text.rlike(C.COMPARE_PATTERN), F.lit("compare")),
        (w["change"], F.lit("repredict")),
        (text.rlike(C.CHANGE_PATTERN) & (F.length(text) < change_length), F.lit("repredict")),
        (w["data_query"], F.lit("data_query")),
        (w["data_word"] & w["question_word"], F.lit("data_query")),
        ((F.length(text) < question_length) & w["short_question"] & rules.contains_any(text, C.NEAR_CITIES), F.lit("region_refine")),
    ]
    return rules.chain(branches, "general")


def intent_counts(messages: DataFrame, text: str) -> DataFrame:
    return messages.groupBy(intent(F.col(text)).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


def request_params(text: Column) -> dict[str, Column]:
    """Estimate parameters told by a message, defaults for the rest."""
    number = found(text, C.REQUEST_AREA_PATTERN).try_cast("double")
    ten_thousands = F.regexp_extract(text, C.REQUEST_AREA_PATTERN, 0).contains("万")
    structures = [(text.contains(word), F.lit(value)) for value, word in C.REQUEST_STRUCTURES]
    decorations = [(text.contains(word), F.lit(value)) for value, word in C.REQUEST_DECORATIONS]
    return {
        "total_area": F.coalesce(F.when(ten_thousands, number * 10000).otherwise(number), F.lit(10000.0)),
        "project_type": rules.first_words(text, C.TYPE_SYNONYMS, "住宅"),
        "location": F.coalesce(rules.first_contained(text, C.REQUEST_LOCATIONS), F.lit("华东")),
        "structure_type": rules.chain(structures, "框架结构"),
        "floors": F.coalesce(found(text, "(\\d+)\\s*[层楼]").try_cast("int"), F.lit(6)),
        "decoration_level": rules.chain(decorations, "普通装修"),
        "build_year": F.lit(2026),
        "project_name": F.lit("对话生成项目"),
    }


def refined_region(text: Column) -> Column:
    """City and zone of a message: a zone word with its city, else a zone name, else a city."""
    zone = rules.first_contained(text, C.ZONE_WORDS)
    city = rules.first_contained(text, C.TALK_CITIES)
    named = found(text, f"([{names.CJK}]{{2,4}}(?:高新区|新区|开发区|科技园|工业园|经开区))")
    return F.coalesce(F.concat(F.coalesce(city, F.lit("")), zone), named, city)


def term(text: Column) -> Column:
    """First glossary term a message mentions."""
    return rules.first_contained(text, C.TERMS)


def tier_of(text: Column) -> Column:
    return names.floor_tier(request_params(text)["floors"])


def session_summary(messages: DataFrame, session: str = "session_id", turn: str = "turn", text: str = "text",
                    title_length: int | None = None) -> DataFrame:
    """Title (the first message, or its start) and message count of every session."""
    title = F.col(text) if title_length is None else F.substring(text, 1, title_length)
    return messages.groupBy(session).agg(
        F.min_by(title, turn).alias("title"), F.count(F.lit(1)).alias("message_count"))


def retain(messages: DataFrame, session: str = "session_id", turn: str = "turn", order: str = "seq",
           sessions: int | None = None, per_session: int | None = None) -> DataFrame:
    """The newest sessions by first appearance, each with its last messages; without a limit, all of them."""
    if sessions is not None:
        first_seen = messages.groupBy(session).agg(F.min(order).alias("_seen"))
        kept = first_seen.orderBy(F.desc("_seen"), F.desc(session)).limit(sessions).select(session)
        messages = messages.join(kept, session, "left_semi")
    if per_session is None:
        return messages
    w = Window.partitionBy(session).orderBy(F.desc(turn))
    return messages.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= per_session).drop("_rank")


def last_messages(messages: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """Last n messages in ascending order."""
    return messages.orderBy(F.desc(order)).limit(n).orderBy(order)


def retain_projects(projects: DataFrame, order: str = "seq", n: int | None = None) -> DataFrame:
    """The newest projects, all without a limit."""
    return projects if n is None else projects.orderBy(F.desc(order)).limit(n)
