"""Judge answers: tolerant JSON parsing, pluggable calls with retries, per-criterion judging and resumable generation."""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import fill, strip_fence, yes_no
from corvane.session import ship

VERDICTS = "array<struct<key:string,part:string,points:double,met:int,reason:string>>"
_ITEM = "array<struct<letra:string,numero:string,parte:string,pontos:double,acerto:string,raciocinio:string>>"
_WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}


class _Lenient:
    """A forgiving JSON reader: raw line feeds, trailing commas, unescaped quotes inside texts, and an end that is cut off.

    A quote ends a text only if what follows it could follow a text in that place.
    """

    _PLAIN = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|[A-Za-z]+")
    _MARK = re.compile(r'["\\]')
    _AFTER = {
        "name": re.compile(r"\s*:"),
        "object": re.compile(r'\s*(?:\}|\Z|,\s*(?:\}|"[^"\n]*"\s*:))'),
        "array": re.compile(r'\s*(?:\]|\Z|,\s*[\]"{\[\dtfnTFN-])'),
    }

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def _space(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at:self.at + 1]

    def value(self, place: str):
        mark = self._space()
        if mark == "{":
            return self._object()
        if mark == "[":
            return self._array()
        if mark == '"':
            return self._string(place)
        found = self._PLAIN.match(self.text, self.at)
        if not found or found.group().isalpha() and found.group() not in _WORDS:
            raise ValueError(f"no value at {self.at}")
        self.at = found.end()
        word = found.group()
        return _WORDS[word] if word in _WORDS else float(word) if any(c in word for c in ".eE") else int(word)

    def _string(self, place: str) -> str:
        self.at += 1
        out = []
        while self.at < len(self.text):
            mark = self._MARK.search(self.text, self.at)
            end = mark.start() if mark else len(self.text)
            out.append(self.text[self.at:end])
            self.at = end
            if not mark:
                break
            c = mark.group()
            if c == "\\" and self.at + 1 < len(self.text):
                size = 6 if self.text[self.at + 1] == "u" else 2
                raw = self.text[self.at:self.at + size]
                try:
                    out.append(json.loads(f'"{raw}"'))
                except ValueError:
                    out.append(raw[1:])
                self.at += size
                continue
            self.at += 1
            if c == '"' and self._AFTER[place].match(self.text, self.at):
                break
            out.append(c)
        return "".join(out)

    def _object(self) -> dict:
        self.at += 1
        out = {}
        while (mark := self._space()) not in ("}", ""):
            if mark == ",":
                self.at += 1
                continue
            if mark != '"':
                raise ValueError(f"no name at {self.at}")
            name = self._string("name")
            if self._space() != ":":
                raise ValueError(f"no value for {name}")
            self.at += 1
            out[name] = self.value("object")
        self.at += 1
        return out

    def _array(self) -> list:
        self.at += 1
        out = []
        while (mark := self._space()) not in ("]", ""):
            if mark == ",":
                self.at += 1
                continue
            out.append(self.value("array"))
        self.at += 1
        return out


def lenient_json(text: str | None):
    """The first object or list of a text, fenced or not; None where there is none."""
    body = re.sub(r"\s*```\s*$", "", re.sub(r"^\s*```(?:json)?\s*", "", text or ""))
    try:
        return json.loads(body, strict=False)
    except ValueError:
        pass
    for start in re.finditer(r"[\[{]", body):
        try:
            return _Lenient(body[start.start():]).value("object")
        except ValueError:
            continue
    return None


def parse_verdict(text: str | None) -> list[dict] | None:
    """Verdict rows of any of four shapes: under ``resultado`` or ``criterios``, a bare list, or an object by letter."""
    value = lenient_json(text) if text else None
    if isinstance(value, dict):
        named = next((value[n] for n in ("resultado", "criterios") if isinstance(value.get(n), list)), None)
        value = named if named is not None else [{"letra": k, **v} for k, v in value.items() if isinstance(v, dict) and "acerto" in v]
    if not isinstance(value, list):
        return None
    text_of = lambda v: None if v is None else str(v)
    return [{
        "key": text_of(x.get("letra", x.get("numero"))), "part": text_of(x.get("parte")), "points": float(p) if isinstance(p := x.get("pontos"), (int, float)) else None,
        "met": int(str(x.get("acerto")).strip() in ("1", "True", "true")), "reason": text_of(x.get("raciocinio")),
    } for x in value if isinstance(x, dict)]


def verdicts(answer: Column | str) -> Column:
    """The verdict rows of an answer column. Well-formed answers are read by Spark's own reader; only the others go to Python, in Arrow batches."""
    @F.pandas_udf(VERDICTS)
    def parse(text: pd.Series) -> pd.Series:
        return text.map(parse_verdict)

    ship(SparkSession.active())
    c = F.col(answer) if isinstance(answer, str) else answer
    read = F.from_json(strip_fence(c), f"struct<resultado:{_ITEM},criterios:{_ITEM}>")
    items = F.coalesce(read["resultado"], read["criterios"])
    native = F.transform(items, lambda x: F.struct(
        F.coalesce(x["letra"], x["numero"]).alias("key"), x["parte"].alias("part"), x["pontos"].alias("points"),
        F.coalesce(F.trim(x["acerto"]).isin("1", "True", "true"), F.lit(False)).cast("int").alias("met"), x["raciocinio"].alias("reason")))
    return F.coalesce(native, parse(F.when(items.isNull(), c)))


def points(rows: Column) -> Column:
    """Points of the met rows of a verdict list, rounded to four digits."""
    return F.round(F.aggregate(rows, F.lit(0.0), lambda t, r: t + F.when(r["met"] == 1, F.coalesce(r["points"], F.lit(0.0))).otherwise(0.0)), 4)


def possible(rows: Column) -> Column:
    return F.round(F.aggregate(rows, F.lit(0.0), lambda t, r: t + F.coalesce(r["points"], F.lit(0.0))), 4)


def payload(criteria: Column, genre: Column) -> Column:
    """The criteria as a judge gets them, as JSON: letter, part, key and points for discursive questions, number, part, title and text for others."""
    letters = F.transform(criteria, lambda c: F.struct(c["letra"].alias("letra"), c["parte"].alias("parte"), F.coalesce(c["gabarito_item"], F.lit("")).alias("gabarito"), c["texto"].alias("criterio"), c["pontuacao_max"].alias("pontos")))
    numbers = F.transform(criteria, lambda c: F.struct(c["numero"].alias("numero"), c["parte"].alias("parte"), F.coalesce(c["titulo"], F.lit("")).alias("titulo"), c["texto"].alias("descricao"), c["pontuacao_max"].alias("pontos")))
    return F.when(genre == "discursiva", F.to_json(letters)).otherwise(F.to_json(numbers))


def echo_ok(token: Column, a: Column, b: Column, answer: Column) -> Column:
    """Whether an answer repeats its token and the sum of its two numbers."""
    return answer.contains(token) & answer.contains((a + b).cast("string"))


def stub(prompt: str, system: str = "") -> str:
    """A fixed answer for offline runs; resume keys leave it out."""
    return "STUB:" + prompt[:40]


class Throttled(Exception):
    """A call that came too soon; hooks raise it so that the next attempt waits longer."""


def retry_wait(attempt: int, throttled: bool, jitter: float = 0.0) -> float:
    """Seconds before the next attempt: 20 times the attempt plus jitter when throttled, else a power of two."""
    return 20.0 * attempt + jitter if throttled else 2.0**attempt


def with_retries(chat: Callable[[str, str], str], retries: int = 5, accept: Callable[[str], bool] = lambda _: True, sleep: Callable[[float], None] = time.sleep) -> Callable[[str, str], str]:
    """``chat`` tried again on errors and on answers that ``accept`` refuses; the last error is raised."""
    def run(prompt: str, system: str = "") -> str:
        for attempt in range(1, retries + 1):
            try:
                answer = chat(prompt, system)
                if accept(answer):
                    return answer
                raise ValueError("answer refused")
            except Exception as e:  # noqa: BLE001 - raised again below
                if attempt == retries:
                    raise
                sleep(0.0 if isinstance(e, ValueError) else retry_wait(attempt, isinstance(e, Throttled), random.random()))
        raise AssertionError("retries must be positive")

    return run


def slot_gap(per_minute: float) -> float:
    """Seconds between calls: the quota less a margin of .40, .70 or .90 of it for up to 5, up to 10, and more calls."""
    margin = 0.4 if per_minute <= 5 else 0.7 if per_minute <= 10 else 0.9
    return 60.0 / (per_minute * margin)


def call(df: DataFrame, prompt: str, out: str = "answer", chat: Callable[[str, str], str] = stub, system: str = "", workers: int = 1, gap: float = 0.0) -> DataFrame:
    """Each row's answer by an injected ``chat(prompt, system)``; an error leaves the answer null and its text in ``error``.

    A task makes ``workers`` calls at a time, answers in row order, and begins one every ``gap`` seconds at most.
    """
    from concurrent.futures import ThreadPoolExecutor

    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField("error", T.StringType())])

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return chat(text, system), None
        except Exception as e:  # noqa: BLE001 - the row records it
            return None, f"{type(e).__name__}: {e}"

    def paced(texts: Sequence[str]) -> Iterator[str]:
        last = 0.0
        for text in texts:
            if gap and (wait := last + gap - time.monotonic()) > 0:
                time.sleep(wait)
            last = time.monotonic()
            yield text

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for pdf in frames:
                got = list(map(one, paced(pdf[prompt]))) if workers == 1 else list(pool.map(one, paced(pdf[prompt])))
                yield pdf.assign(**{out: [a for a, _ in got], "error": [e for _, e in got]})

    return df.mapInPandas(run, schema)


JUDGE_TEMPLATE = "Questão:\n{questao}\n\nGabarito:\n{gabarito}\n\nCritério:\n{criterio}\n\nResposta:\n{resposta}\n\nA resposta cumpre o critério? Responda SIM ou NÃO."


def judge_criteria(df: DataFrame, keys: Sequence[str], question: str, answer: str, key_text: str, criteria: str, chat: Callable[[str, str], str] = stub, template: str = JUDGE_TEMPLATE) -> DataFrame:
    """Each criterion of each answer judged by a call of its own: points earned and possible, their share, and how many were met.

    ``criteria`` is a list of (id, texto, pontuacao_max); points that are null or 0 count 1. An answer without criteria has 0 of 0.
    """
    rows = df.select(*keys, question, answer, key_text, F.explode_outer(criteria).alias("c"))
    prompt = F.when(F.col("c").isNotNull(), fill(template, questao=F.col(question), gabarito=F.col(key_text), criterio=F.col("c")["texto"], resposta=F.col(answer)))
    asked = rows.select(*keys, F.col("c")["id"].alias("criterion"), F.col("c")["pontuacao_max"].cast("double").alias("points"), F.col("c").isNotNull().alias("real"), F.coalesce(prompt, F.lit("")).alias("prompt"))
    judged = call(asked, "prompt", chat=chat).withColumn("points", F.coalesce(F.nullif(F.col("points"), F.lit(0.0)), F.lit(1.0)))
    hit = F.col("real") & (yes_no(F.coalesce("answer", F.lit(""))) == 1)
    sums = judged.groupBy(*keys).agg(
        F.count_if("real").alias("n_criteria"), F.count_if(hit).alias("n_met"), F.sum(F.when(hit, F.col("points")).otherwise(0.0)).alias("earned"), F.sum(F.when(F.col("real"), F.col("points")).otherwise(0.0)).alias("possible"))
    return sums.select(*keys, "n_criteria", "n_met", F.round("earned", 4).alias("earned"), F.round("possible", 4).alias("possible"), F.round(F.coalesce(F.try_divide("earned", "possible"), F.lit(0.0)), 4).alias("score"))


def missing_runs(questions: DataFrame, answers: DataFrame, key: str, runs: int) -> DataFrame:
    """Questions with fewer answers than ``runs``, and how many each lacks; stub answers do not count."""
    done = answers.where(~F.col("answer").startswith("STUB:")).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    lacking = questions.join(done, key, "left").withColumn("lacking", F.lit(runs) - F.coalesce("n", F.lit(0)))
    return lacking.where("lacking > 0").drop("n")


def generate(questions: DataFrame, answers: DataFrame, key: str, prompt: str, runs: int, chat: Callable[[str, str], str] = stub) -> DataFrame:
    """(key, run, answer, error) of the answers that are still lacking, numbered on from those that are there."""
    lacking = missing_runs(questions, answers, key, runs)
    asked = lacking.select(key, prompt, F.explode(F.sequence(F.lit(runs) - F.col("lacking") + 1, F.lit(runs))).alias("run"))
    return call(asked, prompt, chat=chat).select(key, "run", "answer", "error")


def expand(items: DataFrame, done: DataFrame, key: str, prompt: str, chat: Callable[[str, str], str] = stub, model: str = "stub") -> DataFrame:
    """(key, expansion, model, error) of the items without a finished expansion; failed and stub rows of ``done`` are tried again."""
    finished = done.where(F.col("expansion").isNotNull() & ~F.col("expansion").startswith("STUB:")).select(key).distinct()
    asked = items.select(key, prompt).join(finished, key, "left_anti")
    return call(asked, prompt, out="expansion", chat=chat).select(key, "expansion", F.lit(model).alias("model"), "error")


def pending_cells(classes: DataFrame, years: DataFrame, state: DataFrame) -> DataFrame:
    """(class, year, first, last) of the cells of two small level tables that the state does not hold; a failed cell stays done until its row is removed."""
    cells = classes.crossJoin(F.broadcast(years))  # levels of two factors, not rows
    open_cells = cells.join(state.select("class", "year"), ["class", "year"], "left_anti")
    return open_cells.select("class", "year", F.make_date("year", F.lit(1), F.lit(1)).alias("first"), F.make_date("year", F.lit(12), F.lit(31)).alias("last"))


def gated(df: DataFrame, answer: str, least: int = 500) -> DataFrame:
    """(enunciado, resposta) of answers that are JSON with a long enough reply and a statement that tells a case; others are left out."""
    from corvane.functions.text import is_narrative

    read = F.from_json(strip_fence(F.col(answer)), "struct<enunciado:string,resposta:string>")
    rows = df.withColumns({"enunciado": read["enunciado"], "resposta": read["resposta"]})
    return rows.where((F.length("resposta") >= least) & is_narrative(F.col("enunciado")))
