"""Conversations: templates, masks, contexts and flattening over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.functions import prompts as P
from quern.operators.relations import zipped
from quern.suite.base import CODEPOINTS, Suite, cp, digest_sql, quoted, table

suite = Suite()
D = digest_sql
VICUNA, LLAMA = P.template("vicuna_v1"), P.template("llama2")
INST = f"CASE WHEN role = 'user' THEN {quoted(VICUNA['B_INST'])} ELSE {quoted(VICUNA['E_INST'])} END"
SEP = f"CASE WHEN role = 'assistant' THEN {quoted(VICUNA['SEP2'])} ELSE {quoted(VICUNA['SEP'])} END"


@suite.query(f"SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, md5(string_agg({INST} || text || {SEP}, '' ORDER BY turn)) AS prompt FROM conversations GROUP BY conv_id")
def chat_render_vicuna(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return P.render(turns, "conv_id", "turn", "role", "text", VICUNA, "user", "assistant").withColumn("prompt", F.md5("prompt"))


@suite.query(f"""
WITH p AS (SELECT conv_id, turn, role = 'assistant' AS own, {cp(INST)} AS h, {cp('text')} AS b, {cp(SEP)} AS s FROM conversations),
c AS (SELECT conv_id, flatten(list(list_concat(list_concat(h, b), s) ORDER BY turn)) AS t,
  flatten(list(list_concat(list_transform(h, lambda x: 0), list_transform(list_concat(b, s), lambda x: CASE WHEN own THEN 1 ELSE 0 END)) ORDER BY turn)) AS m FROM p GROUP BY conv_id)
SELECT conv_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(list_sum(m) AS INTEGER) AS n_loss, {D('t')} AS tokens, {D('m')} AS mask FROM c""")
def chat_loss_mask(spark, sf_dir):
    t = P.conversation_tokens(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", VICUNA, CODEPOINTS.encode, "user", "assistant")
    return t.select("conv_id", F.size("tokens").alias("n_tokens"), F.aggregate("mask", F.lit(0), lambda a, v: a + v).alias("n_loss"), A.digest(F.col("tokens")).alias("tokens"), A.digest(F.col("mask")).alias("mask"))


PROMPT = " || ' ' || ".join([quoted(LLAMA["B_INST"]), quoted(LLAMA["SYS_PREFIX"]), "text", quoted(LLAMA["E_INST"])])


ANSWER = "lang || ': ' || text"


@suite.query(f"SELECT doc_id, CAST(length({PROMPT}) AS INTEGER) AS n_prompt, CAST(length({ANSWER}) AS INTEGER) AS n_loss, md5({PROMPT} || {ANSWER}) AS rendered FROM documents WHERE lang IS NOT NULL")
def flan_prompt(spark, sf_dir):
    """Instruction and answer as tokens with a mask; rows without loss drop out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", P.instruction_prompt(F.col("text"), LLAMA).alias("prompt"), F.concat("lang", F.lit(": "), "text").alias("answer")).where("answer IS NOT NULL")
    coded = docs.select("doc_id", "prompt", "answer", CODEPOINTS.encode(F.col("prompt")).alias("p"), CODEPOINTS.encode(F.col("answer")).alias("a"))
    masked = coded.withColumn("mask", F.concat(A.filled(0, F.size("p")), A.filled(1, F.size("a")))).where(P.supervised(F.col("mask")))
    return masked.select("doc_id", F.size("p").alias("n_prompt"), F.aggregate("mask", F.lit(0), lambda s, v: s + v).alias("n_loss"), F.md5(F.concat("prompt", "answer")).alias("rendered"))


@suite.query("""
SELECT conv_id, turn, md5(string_agg(CASE role WHEN 'user' THEN '[INST] ' || text || ' [/INST]' WHEN 'assistant' THEN text || '</s>' ELSE '' END, '')
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS context FROM conversations""")
def chat_context(spark, sf_dir):
    out = P.chat_context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", ("[INST] ", " [/INST]"), ("", "</s>"))
    return out.select("conv_id", "turn", F.md5("context").alias("context"))


@suite.query("SELECT doc_id, md5('Q: ' || CASE WHEN doc_id % 2 = 1 THEN lang ELSE '' END || '?') AS prefix, md5('A: ' || text || '.') AS text FROM documents")
def prompt_affixes(spark, sf_dir):
    prefix, text = P.affixed(F.when(F.col("doc_id") % 2 == 1, F.col("lang")), F.col("text"), "Q: ", "?", "A: ", ".")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(prefix).alias("prefix"), F.md5(text).alias("text"))


@suite.query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS idx, role, md5(text) AS text FROM conversations")
def flatten_captions(spark, sf_dir):
    """Parallel lists of a conversation as rows with an index."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(rows.alias("r")).select("conv_id", F.col("r.role").alias("role"), F.col("r.text").alias("text"))
    return zipped(lists, ["role", "text"], "idx").withColumn("text", F.md5("text"))


@suite.query("""
WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS x FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(x[1]) AS prompt, md5(x[2]) AS text FROM c WHERE len(x) = 2""")
def two_turn_pairs(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("value"))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(rows.alias("c"))
    two, prompt, text = P.prompt_and_text(F.col("c"))
    return c.where(two).select("conv_id", F.md5(prompt).alias("prompt"), F.md5(text).alias("text"))


@suite.query("""
SELECT conv_id, CAST(count(*) FILTER (WHERE role <> 'system') AS INTEGER) AS n_turns, md5(coalesce(string_agg(text, '|' ORDER BY turn) FILTER (WHERE role <> 'system'), '')) AS kept
FROM conversations GROUP BY conv_id""")
def role_filter(spark, sf_dir):
    """Human and model turns only; a model turn without a value has its words in another field."""
    name = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    gpt = F.col("role") == "assistant"
    turn = F.struct("turn", name.alias("from"), F.when(~gpt, F.col("text")).alias("value"), F.when(gpt, F.col("text")).alias("text"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("c")).select("conv_id", P.kept_turns(F.col("c")).alias("k"))
    return c.select("conv_id", F.size("k").alias("n_turns"), F.md5(F.array_join(F.col("k.value"), "|")).alias("kept"))


STYLES = ["Describe:", "What is this?", "Tell me more:"]
U = A.hashed_uniform_sql("conv_id", 2)


@suite.query(f"""
WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS x FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, {cp(f"x[CAST(floor({U} * len(x)) AS BIGINT) + 1]")} AS t FROM c)
SELECT conv_id, CAST(len(t) + 1 AS INTEGER) AS n_loss, {D('list_concat(t, [2])')} AS tokens, ['{"', '".join(STYLES)}'][CAST(floor({A.hashed_uniform_sql("conv_id", 4)} * {len(STYLES)}) AS BIGINT) + 1] AS prefix FROM p""")
def caption_choice(spark, sf_dir):
    """One caption of each list and one wording of the request, chosen by hash."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "text")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(rows.alias("r")).select("conv_id", F.col("r.text").alias("x"))
    tokens, mask = P.caption_response(F.col("x"), F.col("conv_id"), CODEPOINTS.encode, CODEPOINTS.eos, 2)
    return c.select("conv_id", F.size(mask).alias("n_loss"), A.digest(tokens).alias("tokens"), P.styled_prefix(STYLES, F.col("conv_id"), 4).alias("prefix"))
