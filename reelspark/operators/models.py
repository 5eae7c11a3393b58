"""Calls to outside models as pluggable functions over batches of rows.

A model is any picklable callable; calls run in Arrow batches on the executors. A task may run twice, so answers should
go to a keyed table (see ``remember``) rather than be relied on to happen once. Keys and secrets belong to the
executors' environment, never into a closure.
"""

from __future__ import annotations

import queue
import re
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.text import already_target
from reelspark.operators import html_pages
from reelspark.operators.segments import interpolated_cues, pack_blocks

# Models that take an effort.
REASONING = re.compile(r"^(gpt-5|o[1-4])", re.IGNORECASE)

ATTEMPTS = 5
TIMEOUT_S = 60.0
RANKED = "video_id {key}, batch long, frame_index int, include boolean, alt_text string, caption string, confidence double, degraded boolean, error string"


class Transcriber(Protocol):
    def __call__(self, audio: bytes) -> str: ...


class Translator(Protocol):
    def __call__(self, text: str, target: str) -> tuple[str, bool]:
        """The translation, and whether it was cut short."""


class Ranker(Protocol):
    def __call__(self, prompt: str, frames: list[dict]) -> list[dict]: ...


class Retryable(Exception):
    """For models to say that asking again may help; every error but a time-out is taken so."""


class TimedOut(Exception):
    """The model hung; asking again for the same is of no use."""


def within(call: Callable, seconds: float | None, *args):
    """The result of a call, or ``TimedOut``; a hung call is left behind on a thread of its own."""
    if seconds is None:
        return call(*args)
    done: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            done.put((call(*args), None))
        except BaseException as e:  # handed over to the caller
            done.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        result, error = done.get(timeout=seconds)
    except queue.Empty:
        raise TimedOut(f"no answer in {seconds:g} s") from None
    if error is not None:
        raise error
    return result


def with_retries(call: Callable, *args, attempts: int = ATTEMPTS, first_wait: float = 2.0, longest: float = 32.0, timeout: float | None = TIMEOUT_S, sleep: Callable[[float], None] = time.sleep):
    """Ask up to ``attempts`` times, waiting twice as long each time; a time-out ends the attempts."""
    for k in range(attempts):
        try:
            return within(call, timeout, *args)
        except TimedOut:
            raise
        except Exception:
            if k == attempts - 1:
                raise
            sleep(min(longest, first_wait * 2**k))
    raise ValueError("attempts must be positive")


@dataclass(frozen=True)
class Provider:
    """A text model behind an address: what it is asked, and how its answer is read. ``post`` sends a request; it reads keys
    from the environment of the executor it runs on.

    ``kind`` chat sends messages with an effort, generate sends a system text and contents with a level of thinking.
    """

    kind: str
    model: str
    post: Callable[[dict], dict]
    level: str | None = None  # by default high for chat, low for generate

    def request(self, text: str, system: str) -> dict:
        if self.kind == "chat":
            messages = [{"role": "system", "content": system}, {"role": "user", "content": text}]
            return {"model": self.model, "messages": messages} | ({"reasoning_effort": self.level or "high"} if REASONING.match(self.model) else {})
        if self.kind == "generate":
            return {"model": self.model, "system_instruction": system, "contents": text, "thinking_level": self.level or "low"}
        raise ValueError(f"unknown kind of provider: {self.kind}")

    def run(self, text: str, system: str) -> tuple[str, bool]:
        """The answer, and whether it was cut short."""
        got = self.post(self.request(text, system))
        first = (got.get("choices") or got.get("candidates") or [{}])[0]
        said = first["message"]["content"] if "message" in first else "".join(p.get("text", "") for p in first.get("content", {}).get("parts", []))
        ended = str(first.get("finish_reason") or first.get("finishReason") or "").lower()
        return said.strip(), ended in ("length", "max_tokens")

    def translator(self, instruction: str = "Translate into {target}. Keep the Markdown.") -> Translator:
        return lambda text, target: self.run(text, instruction.format(target=target))


def halves(text: str) -> tuple[str, str]:
    blocks = [b.strip() for b in text.split("\n\n") if b.strip()]
    if len(blocks) >= 2:
        k = len(blocks) // 2
        return "\n\n".join(blocks[:k]), "\n\n".join(blocks[k:])
    return text[: len(text) // 2], text[len(text) // 2 :]


def translate_text(text: str, target: str, model: Translator, depth: int = 0, sleep: Callable[[float], None] = time.sleep) -> str:
    """A cut-short answer to a long text is asked for again in halves, at most four times deep."""
    answer, cut = with_retries(model, text, target, first_wait=1.0, sleep=sleep)
    if cut and depth < 4 and len(text) > 800:
        return "\n\n".join(translate_text(part, target, model, depth + 1, sleep) for part in halves(text))
    return answer


def translate(
    documents: DataFrame, target: str, model: Translator, *, key: str = "doc_id", text: str = "text", skip_done: bool = True, limit: int = 6000, sleep: Callable[[float], None] = time.sleep
) -> DataFrame:
    """key, translated, skipped, error: texts chunk by chunk; those mostly in the target's script already are copied.

    Null texts stay null. A text whose model fails to the end is null with the error's message.
    """
    done = already_target(text, target) if skip_done else F.lit(False)
    rows = documents.select(F.col(key), F.col(text).alias("_t"), done.alias("skipped"))

    def one(t: str | None) -> tuple[str | None, str | None]:
        try:
            return (None if t is None else "\n\n".join(translate_text(c, target, model, sleep=sleep) if c else c for c in pack_blocks(t, limit))), None
        except Exception as e:  # the text's row says what happened
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [one(t) for t in pdf["_t"]]
            yield pd.DataFrame({key: pdf[key], "translated": pd.Series([t for t, _ in out], dtype=object), "skipped": False, "error": pd.Series([e for _, e in out], dtype=object)})

    copied = rows.where("skipped").select(key, F.col("_t").alias("translated"), "skipped", F.lit(None).cast("string").alias("error"))
    kind = rows.schema[key].dataType.simpleString()
    return copied.unionByName(rows.where("not skipped").select(key, "_t").mapInPandas(run, f"{key} {kind}, translated string, skipped boolean, error string"))


def translate_nodes(
    nodes: DataFrame, key: str, target: str, model: Callable[[list[str], str], list[str]], size: int = 120, sleep: Callable[[float], None] = time.sleep
) -> DataFrame:
    """key, translations (map of id to text), errors: a page's nodes in batches of ``size``, in order; ids count from 0.

    A batch whose answer has another length, or that fails after its attempts, leaves its nodes out, so they stay as they
    are, and adds a message to the page's errors.
    """
    batches = nodes.groupBy(key, F.expr(f"id div {size}").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("nodes"))
    kind = nodes.schema[key].dataType.simpleString()

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for k, batch in zip(pdf[key], pdf["nodes"], strict=True):
                got, error = [], None
                try:
                    got = with_retries(model, [n["text"] for n in batch], target, first_wait=1.0, sleep=sleep)
                    if len(got) != len(batch):
                        error = f"{len(got)} answers to {len(batch)} texts"
                except Exception as e:  # the page's row says what happened
                    error = f"{type(e).__name__}: {e}"
                out += [(k, None, None, error)] if error else [(k, n["id"], t, None) for n, t in zip(batch, got, strict=True)]
            yield pd.DataFrame(out, columns=[key, "id", "text", "error"])

    done = batches.select(key, "nodes").mapInPandas(run, f"{key} {kind}, id int, text string, error string")
    # A page is one document, so its nodes meet in one row.
    pairs = F.filter(F.collect_list(F.struct("id", "text")), lambda p: p["id"].isNotNull())
    return done.groupBy(key).agg(F.map_from_entries(pairs).alias("translations"), F.array_sort(F.collect_list("error")).alias("errors"))


def translate_files(
    files: DataFrame, target: str, model: Translator, nodes_model: Callable[[list[str], str], list[str]] | None = None, *, path: str = "path", text: str = "value", skip_done: bool = True, sleep: Callable[[float], None] = time.sleep
) -> DataFrame:
    """path, translated, skipped, error: pages (.html) node by node, whatever their script; other texts as ``translate`` does.

    Without ``nodes_model`` the nodes go to ``model`` one by one. A page with failed batches keeps their texts and has the
    messages as its error. Paths are unique; rows with a null text give null.
    """
    each = nodes_model or (lambda texts, to: [model(t, to)[0] for t in texts])
    is_page = F.coalesce(F.lower(path).endswith(".html"), F.lit(False))
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("value"))
    pages = rows.where(is_page)
    done = translate_nodes(html_pages.text_nodes(pages, "path", "value"), "path", target, each, sleep=sleep)
    whole = pages.join(done, "path", "left").select(
        "path", html_pages.write_back("value", "translations").alias("translated"), F.lit(False).alias("skipped"), F.nullif(F.array_join(F.coalesce("errors", F.array().cast("array<string>")), "; "), F.lit("")).alias("error")
    )
    return whole.unionByName(translate(rows.where(~is_page), target, model, key="path", text="value", skip_done=skip_done, sleep=sleep))


def transcribe(chunks: DataFrame, model: Transcriber) -> DataFrame:
    """video_id, chunk, text of audio chunks (``audio`` binary); a chunk k starts at k minutes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"video_id": pdf["video_id"], "chunk": pdf["chunk"], "text": [with_retries(model, bytes(a)) for a in pdf["audio"]]})

    return chunks.select("video_id", F.col("chunk").cast("int").alias("chunk"), "audio").mapInPandas(run, "video_id string, chunk int, text string")


def transcribed_cues(chunks: DataFrame, model: Transcriber, chunk_ms: int = 60_000) -> DataFrame:
    """video_id, chunk, cue_idx, start_ms, end_ms, text: what was said in audio chunks of equal length, sentence by sentence."""
    return interpolated_cues(transcribe(chunks, model), ["video_id", "chunk"], "text", F.col("chunk").cast("long") * chunk_ms, F.lit(chunk_ms))


def ask_batch(model: Ranker, prompt: str, frames: list[dict], halve: bool = True, timeout: float | None = TIMEOUT_S, sleep: Callable[[float], None] = time.sleep) -> tuple[list[dict] | None, str | None]:
    """The answers of a batch, or None and why; what fails to the end is asked once more in halves."""

    def whole(prompt: str, frames: list[dict]) -> list[dict]:
        got = model(prompt, frames)
        if len(got) != len(frames):
            raise ValueError(f"{len(got)} answers to {len(frames)} frames")
        return got

    try:
        return with_retries(whole, prompt, frames, timeout=timeout, sleep=sleep), None
    except Exception as e:  # handed on as the batch's error
        error = f"{type(e).__name__}: {e}"
    if halve and len(frames) > 1:
        k = len(frames) // 2
        first = ask_batch(model, prompt, frames[:k], False, timeout, sleep)[0]
        second = ask_batch(model, prompt, frames[k:], False, timeout, sleep)[0] if first is not None else None
        if second is not None:
            return first + second, None
    return None, error


def rank_batches(batches: DataFrame, model: Ranker, timeout: float | None = TIMEOUT_S, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Answers to (video_id, batch, prompt, frames) rows, one per frame; a failed batch gives stubs, flagged degraded, with its error."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for video, batch, prompt, frames in zip(pdf["video_id"], pdf["batch"], pdf["prompt"], pdf["frames"], strict=True):
                asked = [dict(f) for f in frames]
                got, error = ask_batch(model, prompt, asked, timeout=timeout, sleep=sleep)
                for f, a in zip(asked, got or [{}] * len(asked), strict=True):
                    out.append((video, batch, f["frame_index"], bool(a.get("include", True)), a.get("alt_text", ""), a.get("caption", ""), float(a.get("confidence", 0.0)), got is None, error))
            yield pd.DataFrame(out, columns=["video_id", "batch", "frame_index", "include", "alt_text", "caption", "confidence", "degraded", "error"])

    return batches.select("video_id", "batch", "prompt", "frames").mapInPandas(run, RANKED.format(key=batches.schema["video_id"].dataType.simpleString()))


ANSWER = ("include", "alt_text", "caption", "confidence", "degraded")


def rank_frames(frames: DataFrame, prompts: DataFrame, cache: DataFrame, model: Ranker, *, timeout: float | None = TIMEOUT_S, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """video_id, batch, frame_index, timestamp_s, hash, include, alt_text, caption, confidence, degraded, cached.

    ``frames`` has video_id, batch, frame_index, timestamp_s, hash; ``prompts`` has video_id, batch, prompt, that of the
    whole batch even where only a part of it is asked; ``cache`` has hash and the answer's columns. A frame whose hash is
    in the cache takes its answer from there; only the others are asked, batch by batch. ``frame_index`` is unique in a video.
    """
    known = cache.select(F.col("hash").alias("_h"), F.struct(*ANSWER).alias("_a")).where("_h is not null").dropDuplicates(["_h"])
    probed = frames.select("video_id", "batch", "frame_index", "timestamp_s", "hash").join(known, F.col("hash") == F.col("_h"), "left")
    hits = probed.where("_a is not null").select("video_id", "batch", "frame_index", "timestamp_s", "hash", "_a.*", F.lit(True).alias("cached"))
    misses = probed.where("_a is null").drop("_h", "_a")
    # A batch has a bounded size.
    asked = misses.groupBy("video_id", "batch").agg(F.array_sort(F.collect_list(F.struct("timestamp_s", "frame_index"))).alias("f"))
    asked = asked.join(prompts, ["video_id", "batch"], "left").select("video_id", "batch", F.coalesce("prompt", F.lit("")).alias("prompt"), F.transform("f", lambda x: F.struct(x["frame_index"].alias("frame_index"))).alias("frames"))
    answers = rank_batches(asked, model, timeout, sleep).select("video_id", "frame_index", *ANSWER)
    fresh = misses.join(answers, ["video_id", "frame_index"]).select("video_id", "batch", "frame_index", "timestamp_s", "hash", *ANSWER, F.lit(False).alias("cached"))
    return hits.unionByName(fresh)


def remember(cache: DataFrame, answers: DataFrame, key: str, at: str) -> DataFrame:
    """The cache with new answers: the latest of each key. Degraded stubs aren't kept."""
    both = cache.unionByName(answers.where(~F.coalesce(F.col("degraded"), F.lit(False))), allowMissingColumns=True)
    value = F.struct(*[c for c in both.columns if c != key])
    return both.groupBy(key).agg(F.max_by(value, at).alias("_v")).select(key, "_v.*")


def choose_frames(ranked: DataFrame, n: int, *, key: str = "video_id", time_: str = "timestamp_s") -> DataFrame:
    """The frames of a video that go on: the best included ones, or, after any failure, an even sample of all."""
    from reelspark.operators.segments import even_sample

    failed = ranked.groupBy(F.col(key).alias("_k")).agg(F.bool_or("degraded").alias("_failed"))
    marked = ranked.join(failed, F.col(key) == F.col("_k")).drop("_k")
    best = Window.partitionBy(key).orderBy(F.col("confidence").desc(), time_, "frame_index")
    # Spark keeps the n first of each key before it shuffles.
    good = marked.where("not _failed and include").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= n).drop("_n", "_failed")
    spread = even_sample(marked.where("_failed").drop("_failed").withColumn("include", F.lit(True)), key, [time_, "frame_index"], n)
    return good.unionByName(spread)
