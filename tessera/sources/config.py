"""Settings in a JSON file; what is missing or can't be read has its default."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class ModelConfig:
    """The language model that answers prompts, and how it is asked."""

    provider: str = "openai"
    api_key: str | None = None
    model: str = ""
    system_prompt: str = ""


@dataclass(frozen=True)
class Config:
    archive_path: str | None = None
    index_path: str | None = None
    port: int = 8181
    model: ModelConfig = field(default_factory=ModelConfig)


def _known(kind: type, values: object) -> dict:
    """The values of a kind's own fields that have the type of their defaults."""
    found = {}
    for name, f in kind.__dataclass_fields__.items():
        value = values.get(name) if isinstance(values, dict) else None
        if isinstance(value, int if f.type == "int" else str) and not isinstance(value, bool):
            found[name] = value
    return found


def load(spark: SparkSession, path: str) -> Config:
    """The settings of a file in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return Config()
    try:
        values = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    except (TypeError, ValueError):
        return Config()
    if not isinstance(values, dict):
        return Config()
    return Config(**{k: v for k, v in _known(Config, values).items() if k != "model"}, model=ModelConfig(**_known(ModelConfig, values.get("model"))))


def save(spark: SparkSession, path: str, config: Config) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps({k: v for k, v in asdict(config).items() if v is not None}, indent=2).encode()))
    finally:
        out.close()
