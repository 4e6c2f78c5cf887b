"""Image tiles, cached detector responses, and a pluggable detector."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import tile_offset
from ..operators.masks import merge_responses

DETECTIONS = "map<string,array<struct<mask_rle:struct<counts:array<int>,size:array<int>>,score:double,bbox:array<double>>>>"


class DetectorError(RuntimeError):
    pass


class Unreachable(DetectorError):
    """No connection to the detector."""


class TimedOut(DetectorError):
    """The detector took too long."""


class BadStatus(DetectorError):
    """The detector answered with another status than 200."""


class BadAnswer(DetectorError):
    """The detector's answer is no JSON object with every prompt."""


def http_detector(url: str, timeout: float = 600.0) -> Callable[[bytes, list[str]], str]:
    """A detector for `detect` behind an HTTP server: posts {"image": base64, "prompts": [...]}, gets detections by prompt."""

    def ask(image: bytes, prompts: list[str]) -> str:
        body = json.dumps({"image": base64.b64encode(image).decode(), "prompts": prompts}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                text = reply.read().decode()
        except urllib.error.HTTPError as e:
            raise BadStatus(f"status {e.code}") from e
        except TimeoutError as e:
            raise TimedOut(f"no answer in {timeout} s") from e
        except urllib.error.URLError as e:
            raise (TimedOut if isinstance(e.reason, TimeoutError) else Unreachable)(str(e.reason)) from e
        try:
            found = json.loads(text)
        except ValueError as e:
            raise BadAnswer("not JSON") from e
        if not isinstance(found, dict) or set(prompts) - set(found):
            raise BadAnswer("a prompt has no answer")
        return text

    return ask


def tiles(spark: SparkSession, folder: str) -> DataFrame:
    """path, row0, col0, content of the files tile_r*_c*.png, in path order."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", "tile_r*_c*.png").load(folder)
    r, c = tile_offset(F.col("path"))
    return d.select("path", r.alias("row0"), c.alias("col0"), "content").orderBy("path")


def detect(images: DataFrame, detector: Callable[[bytes, list[str]], str], prompts: list[str], identity: str) -> DataFrame:
    """path, key, response (JSON) for each image; key names what the answer depends on: image, model, prompts.

    detector gets an image and the prompts and returns JSON; what it raises carries the tile's path.
    """

    def run(batches):
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    out.append(detector(content, prompts))
                except Exception as e:
                    raise (type(e) if isinstance(e, DetectorError) else DetectorError)(f"{path}: {e}") from e
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.string())], names=["path", "key", "response"])

    key = F.sha2(F.concat_ws("\n", F.sha2("content", 256), F.lit(identity), *map(F.lit, sorted(prompts))), 256)
    return images.select("path", "content", key.alias("key")).mapInArrow(run, "path string, key string, response string")


def parse(responses: DataFrame, column: str = "response") -> DataFrame:
    """tile, prompt, score, bbox, counts, h, w: one row per detection."""
    r, c = tile_offset(F.col("path"))
    d = responses.select(F.col("path").alias("tile"), r.alias("row0"), c.alias("col0"), F.from_json(column, DETECTIONS).alias("m"))
    d = d.select("tile", "row0", "col0", F.explode("m").alias("prompt", "ds")).select("tile", "row0", "col0", "prompt", F.explode("ds").alias("d"))
    return d.select("tile", "row0", "col0", "prompt", F.col("d.score").alias("score"), F.col("d.bbox").alias("bbox"), F.col("d.mask_rle.counts").alias("counts"), F.get("d.mask_rle.size", 0).alias("h"), F.get("d.mask_rle.size", 1).alias("w"))


def missing_prompts(cached: DataFrame, prompts: list[str]) -> DataFrame:
    """path and the prompts that its cached response (a map) lacks."""
    return cached.select("path", F.array_except(F.array(*map(F.lit, prompts)), F.map_keys("detections")).alias("missing")).where(F.size("missing") > 0)


def merge_cache(cached: DataFrame, new: DataFrame) -> DataFrame:
    """Both maps of detections by prompt, the new winning."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{DETECTIONS[11:-1]}>"))
    d = cached.select("path", F.col("detections").alias("a")).join(new.select("path", F.col("detections").alias("b")), "path", "full_outer")
    return d.select("path", merge_responses(F.coalesce("a", empty), F.coalesce("b", empty)).alias("detections"))


def jobs(images: DataFrame, prompts: list[str], identity: str, cached: DataFrame | None = None) -> DataFrame:
    """path, prompt, key of each detection still to make; key names image, prompt and the model's identity."""
    key = F.sha2(F.concat_ws("\n", F.sha2("content", 256), F.lit(identity), "prompt"), 256)
    every = images.withColumn("prompt", F.explode(F.array(*map(F.lit, prompts)))).select("path", "prompt", key.alias("key"))
    return every if cached is None else every.join(cached.select("key"), "key", "left_anti").select("path", "prompt", "key")
