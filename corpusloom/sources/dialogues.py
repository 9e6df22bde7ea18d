"""Normalisers of dialogue and logic records to samples.

Dialogues: (id, source, split, system, turns array<struct<role, text>>). Logic: (id, source, split, task, prompt, completion).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_value, collapse, first_filled, sorted_json, strip
from corpusloom.operators.corpus import running_sum, with_index
from corpusloom.operators.dialogue import perspectives, role_runs
from corpusloom.operators.logic import build_prompt
from corpusloom.sources import files
from corpusloom.sources.lines import numbered_lines, zip_lines

#: System texts and emotion names of the corpora.
DAILY_SYSTEM = "You are a helpful dialogue agent. Respond naturally across the full conversation."
PERSONA_SYSTEM = "You are a persona-consistent dialogue agent."
LIVE_SYSTEM = "You are a Chinese live-streaming dialogue agent. Reply as the streamer."
NATURAL_SYSTEM = "You are a Chinese multi-turn topic-driven dialogue agent. Reply naturally and keep the topic transition smooth."
CPED_SYSTEM = "You are a Chinese personalized and emotional dialogue agent.\nContinue the multi-party conversation as the target speaker."
EMOTIONS = ["no emotion", "anger", "disgust", "fear", "happiness", "sadness", "surprise"]
FOLIO_QUESTION = "Does the conclusion follow from the premises? Conclusion: "


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def by_parity(texts: Column) -> Column:
    """Collapsed, non-blank texts as turns, usr first and then in turn."""
    kept = F.filter(F.transform(texts, collapse), lambda t: t != "")
    return F.transform(kept, lambda t, i: _turn(F.when(i % 2 == 0, "usr").otherwise("agent"), t))


def _samples(df: DataFrame, source: str, id_: Column, split: Column, system: Column, turns: Column) -> DataFrame:
    out = df.select(id_.alias("id"), F.lit(source).alias("source"), split.alias("split"), system.alias("system"), turns.alias("turns"))
    return out.where(F.size("turns") >= 2)


def dailydialog(df: DataFrame) -> DataFrame:
    """From (ordinal, data_split, turns array<struct<speaker, utterance>>): the speaker "system" is the agent; blank utterances go."""
    split = first_filled(collapse(F.col("data_split")), F.lit("train"))
    item = lambda t: _turn(F.when(t.speaker == "system", "agent").otherwise("usr"), collapse(t.utterance))
    turns = F.filter(F.transform("turns", item), lambda t: t.text != "")
    return _samples(df, "dailydialog", F.concat(F.lit("dailydialog-"), split, F.lit("-"), F.col("ordinal")), split, F.lit(DAILY_SYSTEM), turns)


def dailydialog_lines(df: DataFrame) -> DataFrame:
    """From lines (split, line, text, emotions and, where there is one, acts): utterances between __eou__, ids by place; adds emotions by name, "unknown" without a known id, and the ids of acts."""
    turns = by_parity(F.split("text", "__eou__"))

    ids = lambda c: F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))
    names = F.array(*map(F.lit, EMOTIONS))
    known = F.transform(turns, lambda _, i: F.coalesce(F.get(names, F.coalesce(F.get(ids("emotions"), i), F.lit(-1))), F.lit("unknown")))
    acts = [F.transform(turns, lambda _, i: F.get(ids("acts"), i)).alias("acts")] if "acts" in df.columns else []
    out = df.select(
        F.concat(F.lit("dailydialog-"), "split", F.lit("-"), "line").alias("id"), F.lit("dailydialog").alias("source"), "split", F.lit(DAILY_SYSTEM).alias("system"), turns.alias("turns"), known.alias("emotions"), *acts
    )
    return out.where(F.size("turns") >= 2)


def dailydialog_files(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of the text release: dialogues_text.txt, dialogues_emotion.txt and dialogues_act.txt below train, validation and test, joined by line number.

    Of several files of a name below a split the first by path counts. A missing file, or line of one, has no ids; lines of emotions
    or acts beyond the texts count for nothing.
    """
    pattern = r"/(train|validation|test)/(?:.*/)?dialogues_(text|emotion|act)\.txt$"
    split, part = F.regexp_extract("path", pattern, 1), F.regexp_extract("path", pattern, 2)
    first = files.listing(spark, folder, "dialogues_*.txt").where(part != "").groupBy(split.alias("s"), part.alias("p")).agg(F.min_by("path", F.split("path", "/")).alias("path"))
    lines = numbered_lines(spark, folder, "dialogues_*.txt").join(F.broadcast(first.select("path")), "path", "left_semi")  # nine rows at most
    rows = zip_lines(lines, part, ["text", "emotion", "act"], [split.alias("split")]).where("text is not null")
    return dailydialog_lines(rows.select("split", "line", "text", F.col("emotion").alias("emotions"), F.col("act").alias("acts")))


def _persona(lines: Column) -> Column:
    listed = F.transform(F.filter(F.transform(lines, collapse), lambda p: p != ""), lambda p: F.concat(F.lit("- "), p))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.concat(F.lit(PERSONA_SYSTEM + "\nPersona:\n"), F.array_join(listed, "\n"))).otherwise(PERSONA_SYSTEM)


def personachat(df: DataFrame) -> DataFrame:
    """From (split, ordinal, history, personality, candidates), arrays of strings: roles by place, blank turns dropped after that; the last candidate is an agent's turn more. At least two utterances are needed."""
    placed = F.transform("history", lambda t, i: _turn(F.when(i % 2 == 0, "usr").otherwise("agent"), collapse(t)))
    last = F.when(F.coalesce(F.size("candidates"), F.lit(0)) > 0, F.array(_turn(F.lit("agent"), collapse(F.element_at("candidates", -1))))).otherwise(F.array().cast("array<struct<role: string, text: string>>"))
    turns = F.filter(F.concat(placed, last), lambda t: t.text != "")
    return _samples(df.where(F.size("history") >= 2), "personachat", F.concat(F.lit("personachat-"), "split", F.lit("-"), "ordinal"), F.col("split"), _persona(F.col("personality")), turns)


def personachat_records(values: DataFrame) -> DataFrame:
    """(split, ordinal, history, personality, candidates) for personachat() from JSON records (path, ordinal, value): the first list there is of several keys, and the split of the path's name."""
    v = F.parse_json("value")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    split = F.when(F.contains(name, F.lit("valid")) | F.contains(name, F.lit("dev")), "valid").when(F.contains(name, F.lit("test")), "test").otherwise("train")
    pick = lambda *keys: F.coalesce(*[F.try_variant_get(v, f"$.{k}", "array<string>") for k in keys], F.array().cast("array<string>"))
    return values.select(split.alias("split"), "ordinal", pick("history", "dialogue", "utterances").alias("history"), pick("personality", "persona", "personas").alias("personality"), pick("candidates").alias("candidates"))


def personachat_files(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of all PersonaChat files below a folder: JSON and JSON lines by record, CSV and Parquet by row, text by the numbered line protocol."""
    kinds = {r.k for r in files.listing(spark, folder).select(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("k")).distinct().collect()}
    parts = [personachat(personachat_records(files.records(spark, folder, f"*.{k}"))) for k in ("json", "jsonl") if k in kinds]
    for kind in ("csv", "parquet"):
        if kind in kinds:
            read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}")
            rows = read.csv(folder, header=True, multiLine=True, escape='"') if kind == "csv" else read.parquet(folder)
            values = rows.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("ordinal"), F.to_json(F.struct(*rows.columns)).alias("value"))
            parts.append(personachat(personachat_records(values)))
    if "txt" in kinds:
        stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
        parts.append(parlai(numbered_lines(spark, folder).select("path", stem.alias("split"), "line", F.col("value").alias("text"))))
    if not parts:
        return spark.createDataFrame([], "id string, source string, split string, system string, turns array<struct<role: string, text: string>>")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def split_lookup(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """(rank, split, dialog_id) of the lists <split>.txt in a folder, an id a line; later lists have the higher rank."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(folder).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("split"), collapse(F.col("value")).alias("dialog_id"))
    rank = F.array_position(F.array(*map(F.lit, splits)), F.col("split")) - 1
    return lines.where((rank >= 0) & (F.col("dialog_id") != "")).select(rank.cast("int").alias("rank"), "split", "dialog_id")


def parlai(df: DataFrame) -> DataFrame:
    """From lines (split, line, text) of numbered turns: number 1 starts a conversation; "your persona:" lines make the system text; others are usr, tab, agent.

    ``line`` is unique within a split, or within a path and split where there is a column path. Conversations are numbered by running sums over buckets
    of lines, so no split passes through one task.
    """
    keys = ["path", "split"] if "path" in df.columns else ["split"]
    text = strip(F.col("text"))
    lines = df.where(F.contains(text, F.lit(" "))).select(*keys, "line", F.substring_index(text, " ", 1).alias("no"), F.regexp_replace(text, r"^[^ ]* ", "").alias("said"))
    starts = (F.col("no") == "1").cast("long")
    lines = running_sum(lines, starts, "line", "before", keys).withColumn("conv", F.col("before") + starts).drop("before")
    persona = F.startswith("said", F.lit("your persona:"))
    user, agent = collapse(F.split("said", "\t")[0]), collapse(F.get(F.split("said", "\t"), F.lit(1)))
    pair = F.when(~persona & (user != "") & (agent != ""), F.struct("line", F.array(_turn(F.lit("usr"), user), _turn(F.lit("agent"), agent)).alias("t")))
    told = F.when(persona, F.struct("line", collapse(F.regexp_replace("said", "^your persona:", "")).alias("p")))
    convs = lines.groupBy(*keys, "conv").agg(F.array_sort(F.collect_list(pair)).alias("pairs"), F.array_sort(F.collect_list(told)).alias("told")).where(F.size("pairs") > 0)
    convs = with_index(convs, "conv", "n", keys)
    turns = F.flatten(F.transform("pairs", lambda p: p.t))
    return _samples(convs, "personachat", F.concat(F.lit("personachat-"), "split", F.lit("-"), "n"), F.col("split"), _persona(F.transform("told", lambda p: p.p)), turns)


def livechat(pairs: DataFrame, profiles: DataFrame, lines: DataFrame) -> DataFrame:
    """From pairs (streamer, ordinal, pair), profiles (streamer, profile: JSON with sorted keys) and lines (streamer, lines): two-turn samples; the first eight profile lines count."""
    df = pairs.where(F.size("pair") >= 2).join(profiles, "streamer", "left").join(lines, "streamer", "left")
    user, agent = collapse(F.col("pair")[0]), collapse(F.col("pair")[1])
    basic = F.when(F.coalesce("profile", F.lit("{}")) != "{}", F.concat(F.lit("Basic profile: "), "profile"))
    text = F.when(F.size("lines") > 0, F.concat(F.lit("Text profile:\n"), F.array_join(F.transform(F.slice("lines", 1, 8), collapse), "\n")))
    turns = F.array(_turn(F.lit("usr"), user), _turn(F.lit("agent"), agent))
    return _samples(df.where((user != "") & (agent != "")), "livechat", F.concat(F.lit("livechat-"), "streamer", F.lit("-"), "ordinal"), F.lit("subset"), F.concat_ws("\n", F.lit(LIVE_SYSTEM), basic, text), turns)


def naturalconv(df: DataFrame, splits: DataFrame) -> DataFrame:
    """From (ordinal, dialog_id, content) and splits (rank, split, dialog_id): the list of highest rank that names a dialogue gives its split, else train."""
    named = splits.groupBy(collapse(F.col("dialog_id")).alias("key")).agg(F.max_by("split", "rank").alias("split"))
    key = first_filled(collapse(F.col("dialog_id")), F.col("ordinal").cast("string"))
    joined = df.withColumn("key", key).join(named, "key", "left")
    return _samples(joined, "naturalconv", F.concat(F.lit("naturalconv-"), "key"), F.coalesce("split", F.lit("train")), F.lit(NATURAL_SYSTEM), by_parity(F.col("content")))


def hide_names(text: Column, names: list[str]) -> Column:
    """Without the names, the longest first."""
    for name in sorted(names, key=len, reverse=True):
        text = F.replace(text, F.lit(name), F.lit(""))
    return collapse(text)


def cped_system(speaker: Column, hide: bool = False) -> Column:
    trait = lambda c: collapse(F.col(c))
    names = ["Gender", "Age", "Neuroticism", "Extraversion", "Openness", "Agreeableness", "Conscientiousness"]
    profile = sorted_json([(n.lower(), trait(n)) for n in names])
    scene = trait("Scene")
    target = F.lit(None).cast("string") if hide else F.when(speaker != "", F.concat(F.lit("Target speaker: "), speaker, F.lit(".")))
    about = F.when(profile != "", F.concat(F.lit("Target speaker profile: "), profile))
    where = F.when(scene != "", F.concat(F.lit("Conversation conditions: scene="), scene, F.lit(".")))
    return F.concat_ws("\n", F.lit(CPED_SYSTEM), target, about, where)


def cped(df: DataFrame, split: str, hide: bool = False, names: list[str] | None = None) -> DataFrame:
    """From CSV rows with an ordinal: a sample for each dialogue and speaker, that speaker being the agent.

    Rows go by utterance id as text, then ordinal; runs of a role are merged (see role_runs). The system text is from
    the speaker's first row.
    """
    rows = df.withColumns({"d": collapse(F.col("Dialogue_ID")), "u": collapse(F.col("Utterance_ID")), "s": collapse(F.col("Speaker")), "t": collapse(F.col("Utterance"))}).where("d != '' and t != ''")
    said = hide_names(F.col("t"), names or []) if hide else F.when(F.col("s") != "", F.concat("s", F.lit(": "), "t")).otherwise(F.col("t"))
    rows = rows.withColumn("text", said)
    systems = rows.groupBy("d", F.col("s").alias("target")).agg(F.min_by(cped_system(F.col("s"), hide), F.struct("u", "ordinal")).alias("system"))
    runs = role_runs(perspectives(rows.select("d", "u", "ordinal", "s", "text"), "d", "s", ["u", "ordinal"]), ["d", "target"], ["u", "ordinal"])
    turns = F.transform(F.array_sort(F.collect_list(F.struct("run", "role", "text"))), lambda t: _turn(t.role, t.text))
    samples = runs.groupBy("d", "target").agg(turns.alias("turns")).join(systems, ["d", "target"])
    return _samples(samples, "cped", F.concat(F.lit(f"cped-{split}-"), "d", F.lit("-"), "target"), F.lit(split), F.col("system"), F.col("turns"))


def _logic(df: DataFrame, id_: Column, source: Column, split: Column, task: Column, prompt: Column, completion: Column) -> DataFrame:
    return df.select(id_.alias("id"), source.alias("source"), split.alias("split"), task.alias("task"), prompt.alias("prompt"), completion.alias("completion"))


def folio_records(values: DataFrame, source: str, split: str) -> DataFrame:
    """Samples of FOLIO's JSON records (ordinal, value): premises or context, conclusion or question, label or answer; only a conclusion is put as a question."""
    v = F.parse_json("value")
    get = lambda k: clean_value(F.try_variant_get(v, f"$.{k}", "variant"))
    context, label = first_filled(get("premises"), get("context"), F.lit("")), first_filled(get("label"), get("answer"), F.lit(""))
    question = F.when(get("conclusion") != "", F.concat(F.lit(FOLIO_QUESTION), get("conclusion"))).otherwise(get("question"))
    options = F.array(F.lit("True"), F.lit("False"), F.lit("Uncertain"))
    return _logic(values, F.concat(F.lit(f"{source}-{split}-"), "ordinal"), F.lit(source), F.lit(split), F.lit("first_order_logic_entailment"), build_prompt(context, question, options), label)


def choice_records(values: DataFrame, source: str) -> DataFrame:
    """Samples of multiple-choice JSON records (path, ordinal, value); see choices()."""
    v = F.parse_json("value")
    get = lambda k: clean_value(F.try_variant_get(v, f"$.{k}", "variant")).alias(k)
    return choices(values.select("path", "ordinal", get("id"), get("context"), get("question"), F.try_variant_get(v, "$.options", "array<string>").alias("options"), get("answer")), source)


def collect_logic(spark: SparkSession, folio_dir: str | None = None, choice_dir: str | None = None, proof_csv: str | None = None) -> DataFrame:
    """All logic samples there are: FOLIO's JSON lines (split by file name), multiple choice, and proofs from a CSV file, in that order (source_rank)."""
    parts = []
    if folio_dir:
        for split in ("train", "validation"):
            found = files.json_values(spark, folio_dir, f"*{split}*.jsonl")
            parts.append((0, folio_records(found, "folio", split)))
    if choice_dir:
        parts.append((1, choice_records(files.records(spark, choice_dir), "determlr")))
    if proof_csv:
        parts.append((2, proofs(files.csv_rows(spark, proof_csv).withColumn("ordinal", F.monotonically_increasing_id()), "pfolio")))
    ranked = [p.withColumn("source_rank", F.lit(i)) for i, p in parts]
    out = ranked[0]
    for part in ranked[1:]:
        out = out.unionByName(part)
    return out


def folio(df: DataFrame, source: str, split: str) -> DataFrame:
    """From (ordinal, premises array, conclusion, label)."""
    premises = F.array_join(F.filter(F.transform("premises", collapse), lambda p: p != ""), "\n")
    question = F.concat(F.lit(FOLIO_QUESTION), collapse(F.col("conclusion")))
    options = F.array(F.lit("True"), F.lit("False"), F.lit("Uncertain"))
    return _logic(df, F.concat(F.lit(f"{source}-{split}-"), "ordinal"), F.lit(source), F.lit(split), F.lit("first_order_logic_entailment"), build_prompt(premises, question, options), collapse(F.col("label")))


def choices(df: DataFrame, source: str) -> DataFrame:
    """From (path, ordinal, id, context, question, options, answer): rows without question or answer are rejected; split dev where the path says so."""
    split = F.when(F.contains("path", F.lit("dev")), "dev").otherwise("train")
    id_ = first_filled(collapse(F.col("id")), F.concat(F.lit(f"{source}-"), split, F.lit("-"), "ordinal"))
    kept = df.where((collapse(F.col("question")) != "") & (collapse(F.col("answer")) != ""))
    return _logic(kept, id_, F.lit(source), split, F.lit("logical_reasoning_choice"), build_prompt(collapse(F.col("context")), collapse(F.col("question")), F.col("options")), collapse(F.col("answer")))


def proofs(df: DataFrame, source: str) -> DataFrame:
    """From CSV rows with an ordinal; columns by their first filled name: proof and label make the completion."""
    pick = lambda *names: first_filled(*[collapse(F.col(n)) for n in names if n in df.columns], F.lit(None).cast("string"))
    context, question = pick("premises", "context", "story", "input"), pick("conclusion", "question", "query")
    proof, label = pick("proof", "reasoning", "reasoning_chain", "chain"), pick("label", "answer", "target")
    completion = F.concat_ws("\n", proof, label)
    id_ = F.coalesce(pick("id", "example_id"), F.concat(F.lit(f"{source}-"), "ordinal"))
    task = F.when(F.isnotnull(proof), "proof_generation").otherwise("logical_reasoning_choice")
    return _logic(df.where(F.isnotnull(question) & (completion != "")), id_, F.lit(source), F.coalesce(pick("split"), F.lit("train")), task, build_prompt(context, question), completion)
