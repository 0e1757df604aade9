"""Agents: providers, prompts, rounds of answers, votes, the gate."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import zlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text
from ..sources.remote import get_env
from ..storage import step

TOTAL_TOKENS, REPLY_TOKENS = 8000, 4000
NOTICE = "Earlier messages were left out to keep within the length limit."

SYSTEM = "You compare two concepts from different vocabularies and say whether they mean the same thing."
REPLY = "Reply with <answer>yes</answer> or <answer>no</answer>, then <confidence>N</confidence> with N from 0 (a guess) to 10 (certain)."
TASK = "{demonstrations}First concept\n names: {src_names}\n broader: {src_parents}\n narrower: {src_children}\n synonyms: {src_synonyms}\nSecond concept\n names: {tgt_names}\n broader: {tgt_parents}\n narrower: {tgt_children}\n synonyms: {tgt_synonyms}\nDo both name one entity?\n" + REPLY
ROUND = "Answers so far:\n{answers}\nThink them over and answer again.\n" + REPLY
LAST_ROUND = "Answers so far:\n{answers}\nThis is the last round: give your final answer.\n" + REPLY


class ChatProvider(ABC):
    """(system, user) to (reply, input tokens, output tokens). Instances go to the workers, so they pickle."""

    def __init__(self, model: str = "rules", temperature: float = 0.7):
        self.model, self.temperature = model, temperature

    @abstractmethod
    def complete(self, system: str, user: str) -> tuple[str, int, int]: ...


class RuleProvider(ChatProvider):
    """Deterministic offline stand-in: yes where the two concepts' first names share most of their words. No model."""

    def complete(self, system: str, user: str) -> tuple[str, int, int]:
        names = [set(line.split(": ", 1)[1].lower().replace(",", " ").split()) for line in user.splitlines() if line.startswith(" names: ")]
        if len(names) >= 2:
            a, b = names[-2:]
            share = len(a & b) / max(1, len(a | b))
        else:
            share = (zlib.crc32(user.encode("utf-8", "replace")) % 1000) / 1000
        said = "yes" if share >= 0.5 else "no"
        reply = f"<answer>{said}</answer><confidence>{round(10 * max(share, 1 - share))}</confidence>"
        return reply, (len(system) + len(user)) // 4, len(reply) // 4


class HttpProvider(ChatProvider):
    """Chat completions over HTTP; the key is read from the environment where the call is made.

    ``response_format`` asks for a structured reply (a JSON schema as the service takes it). A call that fails for a while (no
    connection, too many requests, server errors) is made ``tries`` times, after longer and longer waits; then it is an error.
    """

    url, key = "", ""

    def __init__(self, model: str, temperature: float = 0.7, max_tokens: int = REPLY_TOKENS, timeout: float = 120.0, response_format: dict | None = None, tries: int = 4, wait: float = 2.0):
        super().__init__(model, temperature)
        self.max_tokens, self.timeout, self.response_format, self.tries, self.wait = max_tokens, timeout, response_format, tries, wait

    def body(self, system: str, user: str) -> dict:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        shape = {"response_format": self.response_format} if self.response_format else {}
        return {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens, **shape}

    @staticmethod
    def read(document: dict) -> tuple[str, int, int]:
        used = document.get("usage") or {}
        return document["choices"][0]["message"]["content"], used.get("prompt_tokens", 0), used.get("completion_tokens", 0)

    def complete(self, system: str, user: str) -> tuple[str, int, int]:
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {get_env(self.key)}"}
        request = urllib.request.Request(self.url, json.dumps(self.body(system, user)).encode(), head)
        for tried in range(1, self.tries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return self.read(json.load(answer))
            except (urllib.error.URLError, TimeoutError) as e:
                if tried == self.tries or isinstance(e, urllib.error.HTTPError) and e.code != 429 and e.code < 500:
                    raise
                time.sleep(self.wait * 2 ** (tried - 1))
        raise ValueError("tries must be 1 at least")


class OpenAIProvider(HttpProvider):
    url, key = "https://api.openai.com/v1/chat/completions", "OPENAI_API_KEY"


class TogetherProvider(HttpProvider):
    url, key = "https://api.together.xyz/v1/chat/completions", "TOGETHER_API_KEY"


CHAT_PROVIDERS: dict[str, type[ChatProvider]] = {"rules": RuleProvider, "openai": OpenAIProvider, "togetherai": TogetherProvider}


def create_chat(backend: str = "rules", model: str = "rules", **options) -> ChatProvider:
    if backend not in CHAT_PROVIDERS:
        raise ValueError(f"unknown chat backend: {backend}")
    return CHAT_PROVIDERS[backend](model=model, **options)


def generate_response(system: str, user: str, backend: str = "rules", model: str = "rules") -> str:
    return create_chat(backend, model).complete(system, user)[0]


def create_agents(n: int, backend: str, model: str) -> list[ChatProvider]:
    return [create_chat(backend, model) for _ in range(n)]


def create_agents_from_config(configs: list[dict]) -> list[ChatProvider]:
    return [create_chat(c["agent_type"], c["agent_name"]) for c in configs]


def agents_table(spark: SparkSession, agents: list[ChatProvider]) -> DataFrame:
    return spark.createDataFrame([(i, type(a).__name__, a.model) for i, a in enumerate(agents)], "agent int, backend string, model string")


def demonstrations(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, demonstrations: a heading and a line an example (source_label, target_label, pred_relation, confidence)."""
    said = F.when(F.col("pred_relation") == 1, "Yes").otherwise("No")
    line = F.format_string("Source: %s; Target: %s -> %s (confidence %d)", "source_label", "target_label", said, "confidence")
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(*by).agg(F.concat(F.lit("Examples:\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("demonstrations"))


def fill(template: str, slots: dict[str, Column]) -> Column:
    """The template with its {slots} replaced by columns."""
    out, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            out.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        out.append(F.coalesce(slots[name], F.lit("")))
    return F.concat(*out)


def task_prompt(src: Column, tgt: Column, src_code: Column, tgt_code: Column, demos: Column | None = None) -> Column:
    """src, tgt: structs of the four lists. Names are the labels and the code, cleaned, distinct and sorted."""
    slots = {"demonstrations": demos if demos is not None else F.lit("")}
    for side, meta, code in (("src", src, src_code), ("tgt", tgt, tgt_code)):
        names = F.array_sort(F.array_distinct(F.concat(meta["labels"], F.array(code))))
        slots[f"{side}_names"] = text.list_text(text.clean_terms(names))
        for k in ("parents", "children", "synonyms"):
            slots[f"{side}_{k}"] = text.list_text(text.clean_terms(meta[k]))
    return fill(TASK, slots)


def round_prompt(history: Column, last: bool) -> Column:
    """history: array<struct<agent, ans, conf, ...>> in order; a line an agent with its answers so far."""
    agents = F.array_sort(F.array_distinct(F.transform(history, lambda h: h["agent"])))
    lines = F.transform(
        agents,
        lambda a: F.concat(
            F.lit("Agent "), (a + 1).cast("string"), F.lit(": "),
            F.array_join(F.transform(F.filter(history, lambda h: h["agent"] == a), lambda h: F.concat(h["ans"].cast("string"), F.lit(" ("), h["conf"].cast("string"), F.lit(")"))), " "),
        ),
    )
    return fill(LAST_ROUND if last else ROUND, {"answers": F.array_join(lines, "\n")})


def context_block(pair: DataFrame, src_hits: Column, tgt_hits: Column, demos: Column) -> Column:
    """What a prompt is led by: right earlier answers, both concepts' metadata, the labels of their nearest concepts."""
    parts = [F.coalesce(demos, F.lit(""))]
    for name, side, hits in (("first", "src", src_hits), ("second", "tgt", tgt_hits)):
        meta = F.col(f"{side}_meta")
        lists = [F.concat(F.lit(f" {k} "), text.list_text(meta[k])) for k in ("parents", "children", "synonyms", "labels")]
        parts.append(F.concat(F.lit(f"About the {name} concept:"), F.concat_ws(";", *lists), F.lit(".\n"), F.lit("Close to it: "), text.list_text(hits), F.lit(".\n")))
    return F.concat(*parts)


def truncate(messages: DataFrame, by: str, order: str, total: int = TOTAL_TOKENS, reply: int = REPLY_TOKENS) -> DataFrame:
    """by, messages array<struct<role, text>>: the first message, then of the others, newest first, each that still fits.

    The order of the conversation is kept; where messages are left out, a notice follows the first one.
    """
    one = F.struct(F.col(order).alias("o"), F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), text.token_estimate(F.col("text")).alias("tokens"))
    all_of = messages.groupBy(by).agg(F.array_sort(F.collect_list(one)).alias("m"))
    zero = F.struct(F.col("m")[0]["tokens"].alias("used"), F.expr("cast(array() as array<struct<role:string,text:string>>)").alias("kept"))
    walk = F.aggregate(
        F.reverse(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0)))),
        zero,
        lambda acc, x: F.when(
            acc["used"] + x["tokens"] <= total - reply,
            F.struct((acc["used"] + x["tokens"]).alias("used"), F.concat(F.array(F.struct(x["role"].alias("role"), x["text"].alias("text"))), acc["kept"]).alias("kept")),
        ).otherwise(acc),
    )
    first = F.array(F.struct(F.col("m")[0]["role"].alias("role"), F.col("m")[0]["text"].alias("text")))
    notice = F.array(F.struct(F.lit("system").alias("role"), F.lit(NOTICE).alias("text")))
    done = all_of.withColumn("w", walk)
    return done.select(by, F.when(F.size("w.kept") + 1 < F.size("m"), F.concat(first, notice, F.col("w.kept"))).otherwise(F.concat(first, F.col("w.kept"))).alias("messages"))


SAID = T.StructType([T.StructField("agent", T.IntegerType()), T.StructField("response", T.StringType()), T.StructField("input_token", T.LongType()), T.StructField("output_token", T.LongType()), T.StructField("error", T.StringType())])


def answered(prompts: DataFrame, agents: list[ChatProvider], system: str = SYSTEM) -> DataFrame:
    """``prompts`` (user, and system if it is a column) with ``said``, what each agent in turn says to the row's prompt; the row stays one.

    A call that fails is an answer without response that holds its error; the other calls go on.
    """
    at, led = prompts.columns.index("user"), prompts.columns.index("system") if "system" in prompts.columns else None

    def ask(agent: ChatProvider, before: str | None, user: str | None) -> tuple:
        try:
            return *agent.complete(before or "", user or ""), None
        except Exception as e:  # one call's failure is kept with its row
            return None, 0, 0, f"{type(e).__name__}: {e}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = [system] * batch.num_rows if led is None else batch.column(led).to_pylist()
            rows = [(k, *ask(a, s, u)) for s, u in zip(before, batch.column(at).to_pylist(), strict=True) for k, a in enumerate(agents)]
            kind = to_arrow_type(SAID)
            said = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(SAID), kind, strict=True)], fields=list(kind))
            ends = pa.array(range(0, len(agents) * batch.num_rows + 1, len(agents)) if agents else [0] * (batch.num_rows + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, said)], names=[*batch.schema.names, "said"])

    return prompts.mapInArrow(work, T.StructType([*prompts.schema, T.StructField("said", T.ArrayType(SAID))]))


def call(prompts: DataFrame, agents: list[ChatProvider], system: str = SYSTEM) -> DataFrame:
    """prompts (pair_id, user, and system if it is a column) to pair_id, agent, response, input_token, output_token, error: every agent answers every prompt."""
    led = ["system"] if "system" in prompts.columns else []
    return answered(prompts.select("pair_id", *led, "user"), agents, system).select("pair_id", F.inline("said"))


def converse(messages: DataFrame, agents: list[ChatProvider], by: str, order: str, total: int = TOTAL_TOKENS, reply: int = REPLY_TOKENS) -> DataFrame:
    """``call`` on conversations (by, order, role, text) that are cut to the length limit first.

    The first message leads; the others follow as one text, a paragraph each, led by their roles where there are several.
    """
    cut = truncate(messages, by, order, total, reply)
    rest = F.slice("messages", 2, F.greatest(F.size("messages") - 1, F.lit(0)))
    said = F.transform(rest, lambda m: F.when(F.size("messages") > 2, F.concat_ws(": ", m["role"], m["text"])).otherwise(m["text"]))
    return call(cut.select(F.col(by).alias("pair_id"), F.col("messages")[0]["text"].alias("system"), F.array_join(said, "\n\n").alias("user")), agents)


def vote(history: DataFrame) -> DataFrame:
    """pair_id, pred, confidence: the most frequent answer (of equals the first said), the mean of its confidences cut to int."""
    by = history.groupBy("pair_id", "ans").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.sum("conf").alias("sum"))
    nth = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("n"), "first"))
    top = by.withColumn("nth", nth).where("nth = 1")
    return top.select("pair_id", F.col("ans").alias("pred"), F.floor(F.col("sum") / F.col("n")).cast("int").alias("confidence"))


def vote_of(history: Column) -> Column:
    """``vote`` on an array of answers: struct<n, first, pred, confidence>."""
    said = F.array_distinct(F.transform(history, lambda h: h["ans"]))

    def counted(answer: Column) -> Column:
        own = F.filter(history, lambda h: h["ans"] == answer)
        return F.struct(
            F.size(own).alias("n"), (-F.array_min(F.transform(own, lambda h: h["seq"]))).alias("first"), answer.alias("pred"),
            F.floor(F.aggregate(own, F.lit(0).cast("long"), lambda s, h: s + h["conf"]) / F.size(own)).cast("int").alias("confidence"),
        )

    return F.array_max(F.transform(said, counted))


def inference(pairs: DataFrame, agents: list[ChatProvider], rounds: int = 1, gate: bool = False, f1: Column | float = 0.0, epsilon: float = 0.0) -> DataFrame:
    """pair_id, pred, confidence, api_metrics, accepted of pairs (pair_id, src_code, tgt_code, src_meta, tgt_meta, context), a row a pair.

    Agents of a round answer side by side, since its prompt holds earlier rounds only; rounds follow one another, each
    written before the next. Calls that fail have no vote; a pair that nobody has answered yet is asked as in the first round,
    and one that nobody answers at all is left out, so that a later run asks again. Answers stay in their pair's row and nothing is
    joined; pairs are spread over all cores first, since a call costs more than a row's move.
    """
    spark = pairs.sparkSession
    none = F.expr("cast(array() as array<struct<seq:int,agent:int,ans:int,conf:int,input_token:bigint,output_token:bigint>>)")
    body = task_prompt(F.col("src_meta"), F.col("tgt_meta"), F.col("src_code"), F.col("tgt_code"))
    spread = pairs.repartition(4 * spark.sparkContext.defaultParallelism)
    state = spread.select("pair_id", none.alias("history"), F.concat("context", body).alias("first"))
    for i in range(rounds):
        user = F.when(F.size("history") > 0, round_prompt(F.col("history"), i == rounds - 1)).otherwise(F.col("first")) if i else F.col("first")
        said = answered(state.select("pair_id", "history", F.when(F.size("history") == 0, F.col("first")).alias("first"), user.alias("user")), agents)
        new = F.transform(
            F.filter("said", lambda x: x["error"].isNull()),
            lambda x: F.struct(
                (F.lit(i * len(agents)) + x["agent"]).cast("int").alias("seq"), x["agent"].alias("agent"), text.yes_no(x["response"]).alias("ans"),
                text.confidence(x["response"]).alias("conf"), x["input_token"].alias("input_token"), x["output_token"].alias("output_token"),
            ),
        )
        told = said.select("pair_id", F.concat("history", new).alias("history"), "first")
        state = step(told.select("pair_id", "history", F.when(F.size("history") == 0, F.col("first")).alias("first")), "round")
    total = lambda name: F.aggregate("history", F.lit(0).cast("long"), lambda s, h: s + h[name])
    used = F.struct(total("input_token").alias("input_token"), total("output_token").alias("output_token"), F.size("history").cast("long").alias("api_calls"))
    out = state.where(F.size("history") > 0).select("pair_id", vote_of(F.col("history")).alias("top"), used.alias("api_metrics"))
    out = out.select("pair_id", "top.pred", "top.confidence", "api_metrics")
    accepted = text.gate_score(F.col("confidence"), f1, epsilon=epsilon) > 0 if gate else F.lit(True)
    return out.select("pair_id", "pred", "confidence", "api_metrics", accepted.alias("accepted"))
