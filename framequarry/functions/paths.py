"""Identifiers and portable paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def posix(path: Column | str) -> Column:
    return F.translate(_c(path), "\\", "/")


def stem(path: Column | str) -> Column:
    """The file name without its last ending."""
    return F.regexp_replace(F.substring_index(posix(path), "/", -1), r"(?<=.)\.[^.]*$", "")


def segment_id(video: Column | str, number: Column | str) -> Column:
    return F.concat(_c(video).cast("string"), F.lit("_seg_"), F.lpad(_c(number).cast("string"), 4, "0"))


def frame_id(segment: Column | str, index: Column | str) -> Column:
    return F.concat(_c(segment), F.lit("_f"), F.lpad(_c(index).cast("string"), 6, "0"))


def item_id(video: Column | str, segment: Column | str) -> Column:
    return F.concat(_c(video).cast("string"), F.lit("::"), _c(segment))


def split_item(item: Column | str) -> Column:
    """struct(video_id, segment_id), cut at the first ``::``; an item without one is the video."""
    at = F.instr(_c(item), "::")
    return F.struct(F.when(at > 0, F.substring(_c(item), F.lit(1), at - 1)).otherwise(_c(item)).alias("video_id"), F.when(at > 0, F.substring(_c(item), at + 2, F.char_length(_c(item)))).otherwise("").alias("segment_id"))


def image_id(path: Column | str, root: str) -> Column:
    """The path below ``root`` without its ending, with slashes."""
    return F.regexp_replace(make_portable(path, root), r"(?<=[^/])\.[^./]*$", "")


def embedding_name(item: Column | str) -> Column:
    return F.concat(F.replace(F.replace(_c(item), F.lit("/"), F.lit("__")), F.lit("\\"), F.lit("__")), F.lit(".npy"))


def make_portable(path: Column | str, root: str) -> Column:
    """The path relative to ``root``; any other path as it is, with slashes."""
    p, root = posix(path), root.rstrip("/") + "/"
    return F.when(p.startswith(root), F.substring(p, F.lit(len(root) + 1), F.char_length(p))).otherwise(p)


def resolve_portable(path: Column | str, root: str) -> Column:
    """An absolute path under ``root``: relative ones are joined to it, foreign absolute ones are cut at the root's last name."""
    p = F.trim(posix(path))
    root = root.rstrip("/")
    anchor = f"/{root.rpartition('/')[2]}/"
    foreign = p.rlike("^([A-Za-z]:)?/") & ~p.startswith(root + "/")
    tail = F.substring_index(p, anchor, -1)
    return F.when(p == "", root).when(p.startswith(root + "/"), p).when(foreign & (F.instr(p, anchor) > 0), F.concat(F.lit(root + "/"), tail)).when(foreign, p).otherwise(F.concat(F.lit(root + "/"), p))


def rewrite_prefix(path: Column | str, rules: list[tuple[str, str]]) -> Column:
    """The first rule whose prefix the path has, whatever the case, replaces it."""
    p = posix(path)
    out = None
    for old, new in rules:
        hit = F.lower(p).startswith(old.lower())
        value = F.concat(F.lit(new), F.substring(p, F.lit(len(old) + 1), F.char_length(p)))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return p if out is None else out.otherwise(p)


def resolve_files(items: DataFrame, files: DataFrame, roots: list[str], endings: tuple[str, ...] = (".jpg", ".jpeg", ".png", "")) -> DataFrame:
    """Rows (item_id, path) with resolved_path: the first of each row's candidates that is among ``files`` (path), or null.

    Candidates are the path itself, the path below each root, then each root with the item and each ending.
    """
    options = [F.col("path"), *[F.concat(F.lit(r.rstrip("/") + "/"), F.col("path")) for r in roots], *[F.concat(F.lit(r.rstrip("/") + "/"), F.col("item_id"), F.lit(e)) for r in roots for e in endings]]
    tried = items.select("item_id", F.posexplode(F.array(*options)).alias("at", "candidate")).filter("candidate is not null")
    found = tried.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("item_id").agg(F.min_by("candidate", "at").alias("resolved_path"))
    return items.join(found, "item_id", "left")


def image_source(source: Column | str) -> Column:
    """struct(kind, bytes): url, path or base64 by its form; the bytes of a base64 one, null if it doesn't decode."""
    s = F.trim(_c(source))
    body = F.regexp_replace(s, "^data:[^,]*,", "")
    kind = F.when(s.rlike("(?i)^https?://"), "url").when(s.rlike(r"^(?:/|\.{1,2}/|[A-Za-z]:)|\.(?i:jpe?g|png|webp|bmp|gif)$"), "path").otherwise("base64")
    return F.struct(kind.alias("kind"), F.when(kind == "base64", F.try_to_binary(body, F.lit("base64"))).alias("bytes"))


# The columns of a record that hold paths.
PATH_COLUMNS = ("path", "video_path", "frame_path", "embedding_path", "embedding_metadata_path", "image_path", "source_path")


def portable_records(rows: DataFrame, root: str, columns: tuple[str, ...] = PATH_COLUMNS) -> DataFrame:
    """Records with their path columns relative to ``root``; other columns stay."""
    return rows.withColumns({c: make_portable(c, root) for c in columns if c in rows.columns})
