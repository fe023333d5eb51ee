"""Caption records, tags and model answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What separates tags, and the names a field may go by.
TAG_SEPARATORS = "[,，;；、|\n]+"
TAG_KEYS = ("tags", "Tags", "标签")
DESCRIPTION_KEYS = ("description", "Description", "描述", "caption")
IMAGE_KEYS = {
    "subject": ("subject", "主体"), "color": ("color", "颜色"), "action": ("action", "动作"), "style": ("style", "风格"), "description": ("description", "描述"),
}
ALIASES = {
    "video_id": ("video_id", "videoID"), "video_path": ("video_path", "videoPath", "path"), "tags": ("tags", "caption_tags", "captionTags"),
    "description": ("description", "caption_description"), "caption": ("caption", "caption_text"), "duration_seconds": ("duration_seconds", "duration"), "model": ("model", "caption_model"),
    "status": ("status",), "created_at": ("created_at", "caption_updated_at"),
}
MAX_TAGS = 8


def filled(*values: Column) -> Column:
    """The first value that isn't null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(v.cast("string")), F.lit("")) for v in values])


def clean_tags(tags: Column) -> Column:
    """Trimmed, without blanks, ordered distinct."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != ""))


def normalize_tags(raw: Column | str, parse_json: bool = True) -> Column:
    """Tags of a JSON list, of a JSON object's tags, or of separated text."""
    raw = F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit(""))
    split = F.split(raw, TAG_SEPARATORS)
    if not parse_json:
        return clean_tags(split)
    listed = F.when(F.trim(raw).startswith("["), F.from_json(F.trim(raw), "array<string>"))
    inside = F.when(F.trim(raw).startswith("{"), F.get_json_object(raw, "$.tags"))
    nested = F.coalesce(F.from_json(inside, "array<string>"), F.split(inside, TAG_SEPARATORS))
    return clean_tags(F.coalesce(listed, nested, split))


def strip_code_fence(text: Column | str) -> Column:
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^```[a-zA-Z0-9_-]*\s*", ""), r"\s*```$", ""))


def first_json_object(text: Column | str) -> Column:
    """From the first brace to the last; null if there are none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def _field(json: Column, keys: tuple[str, ...]) -> Column:
    return filled(*[F.get_json_object(json, f"$['{k}']") for k in keys])


def parse_video_caption(answer: Column | str) -> Column:
    """struct(tags, description, error): error is null if the answer is an object with a description and tags."""
    json = first_json_object(strip_code_fence(answer))
    valid = F.try_parse_json(json).isNotNull()
    description = _field(json, DESCRIPTION_KEYS)
    tags = F.slice(F.coalesce(*[F.nullif(normalize_tags(F.get_json_object(json, f"$['{k}']")), F.array().cast("array<string>")) for k in TAG_KEYS], F.array().cast("array<string>")), 1, MAX_TAGS)
    error = F.when(~F.coalesce(valid, F.lit(False)), "invalid json").when(description.isNull(), "no description").when(F.size(tags) == 0, "no tags")
    return F.struct(tags.alias("tags"), description.alias("description"), error.alias("error"))


def parse_image_caption(answer: Column | str) -> Column:
    """struct(subject, color, action, style, description); an answer that isn't a caption object is the description."""
    clean = strip_code_fence(answer)
    json = F.coalesce(first_json_object(clean), F.lit("{}"))
    got = {k: F.coalesce(_field(json, keys), F.lit("")) for k, keys in IMAGE_KEYS.items()}
    valid = (got["description"] != "") | (got["subject"] != "")
    return F.struct(*[F.when(valid, v).otherwise(clean if k == "description" else F.lit("")).alias(k) for k, v in got.items()])


def display_line(subject: Column, color: Column, action: Column, style: Column) -> Column:
    """The fields in one line, a dash for blank ones."""
    parts = zip(("主体", "颜色", "动作", "风格"), (subject, color, action, style), strict=True)
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{label}: ["), F.coalesce(F.nullif(v, F.lit("")), F.lit("-")), F.lit("]")) for label, v in parts])


def embedding_text(subject: Column, color: Column, action: Column, style: Column, description: Column) -> Column:
    """The display line, and the description if there is one."""
    return F.concat_ws(" ", display_line(subject, color, action, style), F.concat(F.lit("描述: "), filled(description)))


def normalize_records(rows: DataFrame) -> DataFrame:
    """Caption records of any column names the aliases know: one name each, description and caption filled from each other."""
    have = set(rows.columns)
    kind = dict(rows.dtypes)

    def pick(name: str) -> Column:
        found = [F.col(a) for a in ALIASES[name] if a in have]
        return filled(*found) if found else F.lit(None).cast("string")

    tag_columns = [F.col(a) if kind[a].startswith("array") else normalize_tags(a) for a in ALIASES["tags"] if a in have]
    tags = clean_tags(F.coalesce(*tag_columns, F.array().cast("array<string>")))
    description, caption = pick("description"), pick("caption")
    return rows.select(
        pick("video_id").alias("video_id"), pick("video_path").alias("video_path"), F.coalesce(pick("status"), F.when(F.coalesce(description, caption).isNotNull(), "ok").otherwise("missing")).alias("status"),
        tags.alias("tags"), F.coalesce(description, caption, F.lit("")).alias("description"), F.coalesce(caption, description, F.lit("")).alias("caption"),
        pick("duration_seconds").try_cast("double").alias("duration_seconds"), pick("model").alias("model"), pick("created_at").alias("created_at"),
    )


def video_index(video_id: Column | str) -> Column:
    """The integer a name ends in, or null."""
    video_id = F.col(video_id) if isinstance(video_id, str) else video_id
    return F.nullif(F.regexp_extract(video_id, r"(\d+)$", 1), F.lit("")).try_cast("bigint")


def format_intervals(intervals: Column, limit: int = 3) -> Column:
    """The first intervals as ``start-end s (score)``."""
    return F.array_join(F.transform(F.slice(intervals, 1, limit), lambda s: F.format_string("%.1f-%.1f s (%.3f)", s["start"], s["end"], s["score"])), " · ")


def response_text(response: Column | str) -> Column:
    """The text of a model's JSON answer: a chat message (text or list of parts) or an output list; '' if there is none."""
    r = F.col(response) if isinstance(response, str) else response
    parts = lambda raw: F.array_join(F.filter(F.transform(F.from_json(raw, "array<struct<text:string>>"), lambda p: F.trim(p["text"])), lambda t: t != ""), "\n")
    content = F.get_json_object(r, "$.choices[0].message.content")
    outputs = F.from_json(F.get_json_object(r, "$.output"), "array<struct<content:array<struct<text:string>>>>")
    flat = F.array_join(F.filter(F.transform(F.flatten(F.transform(outputs, lambda o: F.coalesce(o["content"], F.array().cast("array<struct<text:string>>")))), lambda p: F.trim(p["text"])), lambda t: t != ""), "\n")
    chat = F.when(content.startswith("["), parts(content)).otherwise(content)
    return F.coalesce(filled(chat), filled(F.get_json_object(r, "$.output_text")), filled(flat), F.lit(""))


def prompt_messages(prompt: Column | str, frames: Column | str) -> Column:
    """The content of a captioning request: the prompt, then each frame as an image part (a data URL of its JPEG bytes)."""
    prompt, frames = (F.col(x) if isinstance(x, str) else x for x in (prompt, frames))
    image = lambda b: F.struct(F.lit("image_url").alias("type"), F.concat(F.lit("data:image/jpeg;base64,"), F.base64(b)).alias("value"))
    return F.concat(F.array(F.struct(F.lit("text").alias("type"), prompt.alias("value"))), F.transform(frames, image))
