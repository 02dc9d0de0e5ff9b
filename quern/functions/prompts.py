"""Prompt templates, conversation rendering and loss masks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import append, choose

# The public prompt formats of these model families.
TEMPLATES: dict[str, dict[str, str] | None] = {
    "null": None,
    "llama2": {
        "B_SYS": "<<SYS>>\n",
        "E_SYS": "\n<</SYS>>\n\n",
        "B_INST": "[INST]",
        "E_INST": "[/INST]",
        "SYS_PREFIX": "<<SYS>>\n"
        "You are a helpful, respectful and honest assistant.     Always answer as helpfully as possible, while being safe.      "
        "Your answers should not include any harmful, unethical,     racist, sexist, toxic, dangerous, or illegal content.     "
        "Please ensure that your responses are socially unbiased     and positive in nature. If a question does not make any sense,     "
        "or is not factually coherent, explain why instead of answering     something not correct. If you don't know the answer to a question,     "
        "please don't share false information."
        "\n<</SYS>>\n\n",
    },
    "mistral": {
        "B_INST": "[INST]",
        "E_INST": "[/INST]",
    },
    "vicuna_v1": {
        "B_INST": "USER: ",
        "E_INST": "ASSISTANT: ",
        "SEP": " ",
        "SEP2": "</s>",
        "SYS_PREFIX": "A chat between a curious user and an     artificial intelligence assistant. The assistant gives helpful, detailed, and     polite answers to the user's questions.",
    },
}


def template(name: str) -> dict[str, str]:
    """A template by name; one that isn't registered, or has no parts, is an error when the plan is built."""
    found = TEMPLATES.get(name)
    if found is None:
        raise ValueError(f"no prompt template {name!r} for conversations")
    return found


def register_template(name: str, parts: dict[str, str]) -> None:
    TEMPLATES[name] = parts


def instruction(role: Column, t: dict[str, str], human: str = "human") -> Column:
    return F.when(role == human, t["B_INST"]).otherwise(t["E_INST"])


def separator(role: Column, t: dict[str, str], assistant: str = "gpt") -> Column:
    if "SEP" not in t or "SEP2" not in t:
        raise ValueError("the template has no separators")
    return F.when(role == assistant, t["SEP2"]).otherwise(t["SEP"])


def render(turns: DataFrame, conv: str, turn: str, role: str, text: str, t: dict[str, str], human: str = "human", assistant: str = "gpt", image: str | None = None) -> DataFrame:
    """``conv, n_turns, prompt``: each conversation's turns in order, each between its instruction and separator."""
    body = F.col(text) if image is None else F.replace(F.col(text), F.lit("<image>"), F.lit(image))
    part = F.concat(instruction(F.col(role), t, human), body, separator(F.col(role), t, assistant))
    rows = turns.select(conv, F.struct(F.col(turn).alias("turn"), part.alias("part")).alias("row"))
    parts = F.transform(F.array_sort(F.collect_list("row")), lambda r: r["part"])
    return rows.groupBy(conv).agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(parts, "").alias("prompt"))


def conversation_tokens(turns: DataFrame, conv: str, turn: str, role: str, text: str, t: dict[str, str], encode, human: str = "human", assistant: str = "gpt", mask_zero: bool = False) -> DataFrame:
    """``conv, tokens, mask``: the parts of each turn encoded one by one, with loss on what the assistant says and its separator.

    With ``mask_zero`` the token 0 never has loss.
    """
    says = F.when(F.col(role) == assistant, 1).otherwise(0)
    head, body, tail = (encode(c) for c in (instruction(F.col(role), t, human), F.col(text), separator(F.col(role), t, assistant)))
    tokens = F.concat(head, body, tail)
    loss = F.concat(F.array_repeat(F.lit(0), F.size(head)), F.array_repeat(says, F.size(body) + F.size(tail)))
    if mask_zero:
        loss = F.zip_with(loss, tokens, lambda m, x: F.when(x > 0, m).otherwise(0))
    rows = turns.select(conv, F.struct(F.col(turn).alias("turn"), tokens.alias("x"), loss.alias("m")).alias("row"))
    ordered = rows.groupBy(conv).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return ordered.select(conv, F.flatten(F.transform("rows", lambda r: r["x"])).alias("tokens"), F.flatten(F.transform("rows", lambda r: r["m"])).alias("mask"))


def supervised(mask: Column) -> Column:
    """True if any token has loss."""
    return F.aggregate(mask, F.lit(0), lambda a, v: a + v) > 0


def instruction_prompt(inputs: Column, t: dict[str, str], system: str = "") -> Column:
    """Begin mark, system prefix, inputs and end mark, with blanks between them."""
    return F.concat_ws(" ", F.lit(t["B_INST"]), F.lit(t.get("SYS_PREFIX", system)), inputs, F.lit(t["E_INST"]))


def affixed(prefix: Column, text: Column, before_prefix: str = "", after_prefix: str = "", before_text: str = "", after_text: str = "") -> tuple[Column, Column]:
    """Prefix (missing is empty) and text with fixed words around them."""
    wrap = lambda c, a, b: F.concat(F.lit(a), F.coalesce(c, F.lit("")), F.lit(b))
    return wrap(prefix, before_prefix, after_prefix), wrap(text, before_text, after_text)


def chat_context(turns: DataFrame, conv: str, turn: str, role: str, text: str, user: tuple[str, str], model: tuple[str, str], user_role: str = "user", model_role: str = "assistant") -> DataFrame:
    """The context after each turn: user and model words between their affixes, in order; other roles add nothing."""
    from pyspark.sql import Window

    said = F.when(F.col(role) == user_role, F.concat(F.lit(user[0]), F.col(text), F.lit(user[1]))).when(F.col(role) == model_role, F.concat(F.lit(model[0]), F.col(text), F.lit(model[1]))).otherwise("")
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("context", F.array_join(F.collect_list(said).over(w), ""))


def kept_turns(conversation: Column, roles: tuple[str, ...] = ("human", "gpt")) -> Column:
    """Turns of the given roles; a missing value falls back to ``text``. Takes an array of ``from, value, text``."""
    return F.transform(F.filter(conversation, lambda c: c["from"].isin(*roles)), lambda c: F.struct(c["from"].alias("from"), F.coalesce(c["value"], c["text"]).alias("value")))


def prompt_and_text(conversation: Column) -> tuple[Column, Column, Column]:
    """(whether there are just two turns, the first one's value, the second one's)."""
    return F.size(conversation) == 2, F.get(conversation, 0)["value"], F.get(conversation, 1)["value"]


def caption_response(captions: Column, key: Column, encode, eos: int, seed: int = 0) -> tuple[Column, Column]:
    """One caption of a list with its end of sequence, and loss on all of it."""
    tokens = append(encode(choose(captions, key, seed)), eos)
    return tokens, F.array_repeat(F.lit(1), F.size(tokens))


def styled_prefix(styles: list[str], key: Column, seed: int = 0) -> Column:
    """One of several wordings of a request, by hash of the key."""
    return choose(F.array(*map(F.lit, styles)), key, seed)
