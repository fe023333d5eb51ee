"""Profiles (isolated sets of tables) and settings of a deployment."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

# The tables of a profile.
ARTIFACTS = ("videos", "segments", "frames", "tasks", "search_documents", "vectors_frame", "vectors_segment", "vectors_video")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


@dataclass(frozen=True)
class Profile:
    name: str
    root: str
    legacy_root: str | None = None

    def path(self, spark: SparkSession, artifact: str) -> str:
        """Where an artifact lies: below the root, or below the legacy root if it exists only there."""
        if artifact not in ARTIFACTS:
            raise ValueError(f"unknown artifact: {artifact}")
        own = f"{self.root.rstrip('/')}/{self.name}/{artifact}"
        if self.legacy_root and not exists(spark, own):
            old = f"{self.legacy_root.rstrip('/')}/{self.name}/{artifact}"
            if exists(spark, old):
                return old
        return own

    def check(self, spark: SparkSession, artifacts: tuple[str, ...] = ARTIFACTS, strict: bool = False) -> list[str]:
        """The artifacts that are missing; in strict mode they raise."""
        missing = [a for a in artifacts if not exists(spark, self.path(spark, a))]
        if missing and strict:
            raise RuntimeError(f"profile {self.name} lacks {', '.join(missing)}")
        return missing


def parse_env(text: str) -> dict[str, str]:
    """KEY=VALUE lines; comments, ``export`` and surrounding quotes are taken off."""
    out = {}
    for line in text.splitlines():
        key, equals, value = line.strip().removeprefix("export ").partition("=")
        key, value = key.strip(), value.strip()
        if equals and key and not key.startswith("#"):
            out[key] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def env_first(*names: str) -> str | None:
    """The first of these environment variables that isn't blank."""
    return next((v.strip() for n in names if (v := os.environ.get(n)) and v.strip()), None)
