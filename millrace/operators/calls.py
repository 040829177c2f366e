"""The boundary to a language model: prompts as columns, calls by an injected client with retries, rounds, repair, fallback."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Client = Callable[[str], str]


def messages(system: str, question: Column, shot: tuple[str, str] | None = None) -> Column:
    """Array of (role, content): the system's text, an example as a pair of user and assistant if given, the question."""
    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    pair = [turn("user", F.lit(shot[0])), turn("assistant", F.lit(shot[1]))] if shot else []
    return F.array(turn("system", F.lit(system)), *pair, turn("user", question))


def case_question(person: Column, procedure: Column, fact: Column) -> Column:
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"【{name}】\n"), F.coalesce(c, F.lit(""))) for name, c in (
        ("人员信息", person), ("诉讼过程", procedure), ("案件事实", fact))])


def flat_prompt(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n\n")


def json_prompt(instruction: str, **fields: Column) -> Column:
    """An instruction with the fields as a JSON object."""
    return F.concat(F.lit(instruction + "\n"), F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])))


def label_prompt(labels: list[str], fact: Column) -> Column:
    return F.concat(F.lit("候选罪名：" + "、".join(labels) + "\n\n案件事实：\n"), F.coalesce(fact, F.lit("")))


def stub(prompt: str) -> str:
    """A client that needs no network: an answer fixed by the prompt's hash."""
    n = int(hashlib.md5(prompt.encode()).hexdigest(), 16)
    return f'{{"accusation": ["{("盗窃", "抢夺", "诈骗")[n % 3]}"]}}'


def call(df: DataFrame, make_client: Callable[[], Client], prompt: str = "prompt", tries: int = 4, wait: Callable[[int], float] = lambda k: 2.0**k,
         retry_on: tuple[str, ...] = ()) -> DataFrame:
    """df with reply, attempts and error: each row's prompt is sent until an answer comes, tries times at most.

    make_client is called once a task. With retry_on, only errors that hold one of these texts are tried again. A failure is
    a row with a null reply, so that a later round may take it up; a null prompt is not sent.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType()), T.StructField("attempts", T.IntegerType()),
                           T.StructField("error", T.StringType())])

    def run(frames: Iterable):
        client = make_client()
        for frame in frames:
            replies, attempts, errors = [], [], []
            for p in frame[prompt]:
                reply = error = None
                k = 0
                while isinstance(p, str) and reply is None and k < tries:
                    k += 1
                    try:
                        reply, error = client(p), None
                    except Exception as e:  # noqa: BLE001  a client may raise anything; it is recorded
                        error = str(e)
                        if retry_on and not any(x in error for x in retry_on):
                            break
                        if k < tries:
                            time.sleep(wait(k - 1))
                replies.append(reply)
                attempts.append(k)
                errors.append(error)
            yield frame.assign(reply=replies, attempts=attempts, error=errors)

    return df.mapInPandas(run, schema)


def rounds(df: DataFrame, key: str, ask: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, str], DataFrame], n: int = 3) -> DataFrame:
    """Up to n rounds of ask() over the rows still without a reply; each round is written by save(), none is asked twice."""
    todo, done = df, None
    for k in range(n):
        got = save(ask(todo), f"round{k}")
        ok = got.where("reply is not null")
        done = ok if done is None else done.unionByName(ok)
        todo = df.join(done.select(key), key, "left_anti")
        if k < n - 1 and not todo.limit(1).count():
            break
    return done


def repaired(df: DataFrame, issues: Callable[[str], Column], ask: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, str], DataFrame],
             key: str, passes: int = 2) -> DataFrame:
    """The better of each row's replies: those with issues are asked again, with them in the prompt, and the reply of fewest
    issues stays, of equal ones the earliest."""
    first = save(ask(df).withColumn("pass", F.lit(0)).withColumn("issues", issues("reply")), "pass0")
    every, last = first, first
    for k in range(1, passes + 1):
        again = last.where("size(issues) > 0").select(*[c for c in df.columns if c != "prompt"], F.concat(
            "prompt", F.lit("\n\n"), F.array_join("issues", "\n")).alias("prompt"))
        if not again.limit(1).count():
            break
        last = save(ask(again).withColumn("pass", F.lit(k)).withColumn("issues", issues("reply")), f"pass{k}")
        every = every.unionByName(last)
    best = F.min_by(F.struct("reply", "issues", "pass"), F.struct(F.size("issues"), "pass"))
    return every.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def or_rule(reply: Column, rule: Column) -> Column:
    """What the model gave, else what the rule gives."""
    return F.coalesce(reply, rule)
