"""Model requests as rows, and replies parsed into typed rows or rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeline.functions.records import UUID, decode_string_array, decode_world_state, normalize_enum
from tomeline.functions.text import event_label, strip_fences, strip_reasoning, trim
from tomeline.operators.tables import visible_only

Parts = tuple[DataFrame, DataFrame]

# Settings of each task's request, and our own wording of its instructions.
TASKS: dict[str, dict[str, object]] = {
    "chat": {"temperature": 0.7, "max_tokens": 1024, "system": "Answer the game master's question from the excerpts below. Say so where they do not hold the answer."},
    "chat_player": {"temperature": 0.7, "max_tokens": 1024, "system": "Answer a player's question from the excerpts below, and give away nothing that is hidden from players."},
    "session_summary": {"temperature": 0.5, "max_tokens": 1024, "system": "Summarise the session from its log for the game master, in order, with open threads last."},
    "session_summary_player": {"temperature": 0.5, "max_tokens": 1024, "system": "Retell the session from its log for the players, in order."},
    "encounter": {"temperature": 0.8, "max_tokens": 1024, "system": "Propose an encounter for the party described below. Reply with one JSON object only."},
    "backstory": {"temperature": 0.3, "max_tokens": 1024, "system": "List motivations, key relationships, secrets and plot hooks of this backstory. Reply with one JSON object only."},
    "document_summary": {"temperature": 0.3, "max_tokens": 256, "system": "Summarise in two sentences what this document is about."},
    "page": {"temperature": 0.0, "max_tokens": 4096, "system": "Transcribe this page. Reply with one JSON object that has raw_text, headings and is_dm_only."},
}
ENCOUNTER = "title string, description string, encounter_type string, challenge_rating double, suggested_enemies array<struct<name:string,count:int,cr:double>>, narrative_hook string, alternative string"
ENCOUNTER_TYPES = ["combat", "social", "exploration", "puzzle", "mixed"]
BACKSTORY = "motivations array<string>, key_relationships array<string>, secrets array<string>, plot_hooks array<struct<description:string,priority:string>>"
PAGE = "raw_text string, headings array<string>, is_dm_only boolean"


def build_requests(df: DataFrame, task: str | list[str], content: Column, context: Column | None = None, key: str = "request_id") -> DataFrame:
    """One request row per input row and task: messages (system and user), task, temperature and token limit.

    Several tasks are asked in one pass over the rows, which are worked out once.
    """
    tasks = [task] if isinstance(task, str) else task
    setting = lambda t: F.struct(F.lit(t).alias("task"), *[F.lit(TASKS[t][c]).alias(c) for c in ("system", "temperature", "max_tokens")])
    rows = df.select(F.col(key).alias("request_id"), content.alias("_content"), (F.lit("") if context is None else F.coalesce(context, F.lit(""))).alias("_context"))
    rows = rows.withColumn("_s", F.explode(F.array(*[setting(t) for t in tasks])))
    system = F.when(F.col("_context") == "", F.col("_s.system")).otherwise(F.concat("_s.system", F.lit("\n\n"), "_context"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return rows.select(
        "request_id",
        "_s.task",
        F.array(message("system", system), message("user", F.col("_content"))).alias("messages"),
        "_s.temperature",
        "_s.max_tokens",
    )


def fallback_responses(primary: DataFrame, secondary: DataFrame, key: str = "request_id") -> DataFrame:
    """The primary reply of each request, or the secondary one where it has none; requests of either side."""
    fields = [c for c in primary.columns if c != key]
    first = primary.filter(F.col("content").isNotNull()).select(key, F.struct(*fields).alias("_a"))
    second = secondary.filter(F.col("content").isNotNull()).select(key, F.struct(*fields).alias("_b"))
    both = first.join(second, key, "full").select(key, F.coalesce("_a", "_b").alias("_r"))
    return both.select(key, "_r.*")


def worked_out(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with a column more that is worked out once a row: the optimizer would repeat it wherever it is used."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def parse_page_responses(replies: DataFrame) -> DataFrame:
    """Pages from OCR replies ``doc_id, page_num, content``.

    A reply that is no JSON object of a page is the page's text as it stands; a failed
    page (null content) is an empty text that keeps its place.
    """
    said = worked_out(replies, "_reply", strip_reasoning(F.col("content")))
    page = worked_out(said, "_p", F.from_json(strip_fences(F.col("_reply")), PAGE))
    return page.select(
        "doc_id",
        "page_num",
        F.coalesce("_p.raw_text", "_reply", F.lit("")).alias("raw_text"),
        F.coalesce("_p.headings", F.array().cast("array<string>")).alias("headings"),
        F.coalesce("_p.is_dm_only", F.lit(False)).alias("is_dm_only"),
    )


def split_parsed(rows: DataFrame, whole: Column, reason: Column) -> Parts:
    marked = rows.withColumn("_ok", F.coalesce(whole, F.lit(False)))
    return marked.filter("_ok").drop("_ok"), marked.filter(~F.col("_ok")).withColumn("reject_reason", reason).drop("_ok")


def read_generated_encounters(replies: DataFrame) -> DataFrame:
    """``request_id, content``, the encounter that each reply holds, and why it holds none, in one pass.

    Needed: title, description, hook, a known type, and a list of enemies that each have
    a name and a count.  The challenge rating, an enemy's rating and the alternative may
    be missing.
    """
    said = worked_out(replies, "_reply", strip_reasoning(F.col("content")))
    rows = worked_out(said, "_json", F.coalesce(strip_fences(F.col("_reply")), F.lit("")))
    rows = worked_out(rows, "encounter", F.from_json("_json", ENCOUNTER))
    e = lambda c: F.col(f"encounter.{c}")
    whole = e("title").isNotNull() & e("description").isNotNull() & e("narrative_hook").isNotNull() & e("encounter_type").isin(ENCOUNTER_TYPES) & e("suggested_enemies").isNotNull()
    whole &= F.forall(e("suggested_enemies"), lambda x: x["name"].isNotNull() & x["count"].isNotNull() & (x["count"] >= 0))
    reason = F.when(F.coalesce(whole, F.lit(False)), None).when(F.col("_json") == "", "empty reply").otherwise("not an encounter")
    return rows.select("request_id", "content", "encounter", reason.alias("reject_reason"))


def parse_generated_encounters(replies: DataFrame) -> Parts:
    """Typed encounters from ``request_id, content``, and the replies that hold none."""
    rows = read_generated_encounters(replies)
    good, bad = rows.filter("reject_reason IS NULL"), rows.filter("reject_reason IS NOT NULL")
    return good.select("request_id", "encounter.*"), bad.select("request_id", "content", "reject_reason")


def suggested_enemies(encounters: DataFrame) -> DataFrame:
    """A row for each suggested enemy of each encounter, with its place."""
    flat = encounters.select("request_id", F.posexplode("suggested_enemies").alias("enemy_ix", "e"))
    return flat.select("request_id", "enemy_ix", F.col("e.name").alias("name"), F.col("e.count").alias("count"), F.col("e.cr").alias("cr"))


def parse_backstories(replies: DataFrame, characters: DataFrame) -> Parts:
    """Backstories from ``character_id, content``, with the characters' own texts, and the replies that hold none."""
    rows = worked_out(replies, "_b", F.from_json(trim(F.col("content")), BACKSTORY))
    b = lambda c: F.col(f"_b.{c}")
    whole = b("motivations").isNotNull() & b("key_relationships").isNotNull() & b("secrets").isNotNull() & b("plot_hooks").isNotNull()
    whole &= F.forall(b("plot_hooks"), lambda h: h["description"].isNotNull() & h["priority"].isNotNull())
    good, bad = split_parsed(rows, whole, F.lit("not a backstory"))
    raw = characters.select(F.col("id").alias("character_id"), "campaign_id", F.col("backstory.raw_text").alias("_raw"))
    joined = good.join(raw, "character_id")
    story = F.struct(F.coalesce("_raw", F.lit("")).alias("raw_text"), b("motivations").alias("motivations"), b("key_relationships").alias("key_relationships"), b("secrets").alias("secrets"), b("plot_hooks").alias("plot_hooks"))
    return joined.select("character_id", "campaign_id", story.alias("backstory")), bad.select("character_id", "content", "reject_reason")


def plot_hooks(stories: DataFrame) -> DataFrame:
    """Hook rows of ``parse_backstories``: unknown priorities are low; all active and extracted."""
    flat = stories.select("character_id", "campaign_id", F.posexplode("backstory.plot_hooks").alias("hook_ix", "h"))
    return flat.select(
        F.md5(F.concat_ws(":", F.col("character_id").cast("string"), F.col("hook_ix").cast("string"), F.col("h.description"))).alias("id"),
        "character_id",
        "campaign_id",
        F.col("h.description").alias("description"),
        normalize_enum(F.col("h.priority"), "hook_priority").alias("priority"),
        F.lit(True).alias("is_active"),
        F.lit(True).alias("llm_extracted"),
    )


def involved_bridge(events: DataFrame) -> DataFrame:
    """``event_id, character_id`` from a JSON column of ids; what is no UUID is dropped."""
    ids = F.filter(decode_string_array(F.col("involved_character_ids")), lambda x: x.rlike(UUID))
    return events.select(F.col("id").alias("event_id"), F.explode(ids).alias("character_id"))


def quests(campaigns: DataFrame) -> DataFrame:
    """``campaign_id, status, quest_ix, quest`` from the world state JSON."""
    state = campaigns.select(F.col("id").alias("campaign_id"), decode_world_state(F.col("world_state")).alias("w"))
    parts = [state.select("campaign_id", F.lit(s).alias("status"), F.posexplode(f"w.{s}_quests").alias("quest_ix", "quest")) for s in ("active", "completed")]
    return parts[0].unionByName(parts[1])


def session_transcript(events: DataFrame, perspective: str = "dm", hide: bool = True) -> DataFrame:
    """``session_id, transcript, n_events``: ``[Label] description`` lines in order of time, ties by id.

    For players (in any case of letters) only visible events count, unless ``hide`` is off.
    """
    rows = visible_only(events) if perspective.lower() == "player" and hide else events
    line = F.concat(F.lit("["), event_label(normalize_enum(F.col("event_type"), "event_type")), F.lit("] "), F.coalesce("description", F.lit("")))
    lines = rows.select("session_id", F.struct(F.col("occurred_at").alias("t"), F.col("id").alias("i"), line.alias("line")).alias("_x"))
    return lines.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["line"]), "\n").alias("transcript"), F.count(F.lit(1)).alias("n_events"))


def doc_summaries(docs: DataFrame, replies: DataFrame) -> DataFrame:
    """Summary rows ``scope, doc_id, doc_name, filename, summary, ingested_at``; a failed reply gives an empty summary."""
    said = replies.select(F.col("request_id").alias("doc_id"), strip_reasoning(F.col("content")).alias("_said"))
    rows = docs.join(said, "doc_id", "left")
    return rows.select("scope", "doc_id", F.col("title").alias("doc_name"), "filename", F.coalesce("_said", F.lit("")).alias("summary"), "ingested_at")


def entries_of(index: DataFrame) -> DataFrame:
    """Meta index documents ``scope, entries`` as one row per entry."""
    return index.select("scope", F.explode("entries").alias("e")).select("scope", "e.*")


def index_of(entries: DataFrame, per_document: int = 10_000) -> DataFrame:
    """Entries as index documents ``scope, entries``, ordered by id; a scope of more than ``per_document`` entries has several."""
    fields = [c for c in entries.columns if c != "scope"]
    most = entries.groupBy("scope").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    part = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-most // per_document)))).alias("_part")
    return entries.groupBy("scope", part).agg(F.sort_array(F.collect_list(F.struct("doc_id", *[c for c in fields if c != "doc_id"]))).alias("entries")).drop("_part")


def numbered_events(events: DataFrame) -> DataFrame:
    """Events with their place in their session's order of time."""
    return events.withColumn("event_ix", F.row_number().over(Window.partitionBy("session_id").orderBy("occurred_at", "id")))
