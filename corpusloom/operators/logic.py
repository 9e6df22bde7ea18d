"""Logic samples: prompts, replies, options, symbols of first-order logic, contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse, strip

#: Keys of metadata that hold reasoning and formal logic, in order.
REASONING_KEYS = ["proof", "proofs", "reasoning", "reasoning_chain", "reasoning chains", "rationale", "explanation", "solution", "chain", "cot", "derivation"]
FORMAL_KEYS = ["premises-FOL", "conclusion-FOL"]
#: Names of first-order logic that are no symbols.
VARIABLES = ["x", "y", "z", "u", "v", "w"]
LOGIC_WORDS = ["forall", "exists", "true", "false"]


def build_prompt(context: Column, question: Column, options: Column | None = None) -> Column:
    """Context, question and options where not empty, then "Answer:", with blank lines between."""
    block = lambda name, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"{name}:\n"), text))
    listed = F.array_join(F.transform(options, collapse), "\n") if options is not None else F.lit(None).cast("string")
    return F.concat_ws("\n\n", block("Context", context), block("Question", question), block("Options", listed), F.lit("Answer:"))


def contains_text(haystack: Column, needle: Column) -> Column:
    """Whether one text holds the other, white space being equal."""
    return F.contains(collapse(haystack), collapse(needle))


def metadata_values(metadata: Column, wanted: list[str]) -> Column:
    """Of a map of strings: (key, value) structs for the wanted keys, in their order and whatever their case; empty values are left out.

    Of keys that differ only in case the last counts.
    """
    named = lambda key: F.filter(F.map_entries(metadata), lambda e: F.lower(e.key) == key.lower())
    found = F.array(*[F.get(F.reverse(named(key)), F.lit(0)) for key in wanted])
    return F.filter(F.transform(found, lambda e: F.struct(e.key.alias("key"), strip(e.value).alias("value"))), lambda e: F.coalesce(e.value, F.lit("")) != "")


def selected_option(answer: Column, options: Column) -> Column:
    """The option that an answer names by letter, by number (from 0, else from 1) or by its beginning; empty if none."""
    short = F.upper(F.regexp_replace(strip(answer), r"[.。)]+$", ""))
    n = F.size(options)
    letter = F.when(short.rlike("^[A-Z]$"), F.ascii(short) - 65)
    number = F.when(short.rlike("^[0-9]+$"), short.try_cast("int"))
    begins = F.get(F.filter(options, lambda o: F.startswith(F.upper(strip(o)), short)), F.lit(0))
    at = lambda i: F.when((i >= 0) & (i < n), strip(F.get(options, i)))
    return F.coalesce(at(letter), at(number), at(number - 1), strip(begins), F.lit(""))


def expand_answer(answer: Column, options: Column) -> Column:
    """The answer, with the option it selects on a line of its own unless the answer holds it."""
    chosen = selected_option(answer, options)
    plain = F.isnull(options) | (F.coalesce(answer, F.lit("")) == "") | (chosen == "") | contains_text(answer, chosen)
    return F.when(plain, answer).otherwise(F.concat(answer, F.lit("\nSelected option: "), chosen))


def build_reply(completion: Column, metadata: Column, options: Column) -> Column:
    """Reasoning, formal logic and answer in sections; what the completion holds already isn't repeated."""
    answer = strip(completion)
    reasons = F.transform(F.filter(metadata_values(metadata, REASONING_KEYS), lambda e: ~contains_text(answer, e.value)), lambda e: e.value)
    formal = metadata_values(metadata, FORMAL_KEYS)
    formal_text = F.concat(F.lit("Formal logic:\n"), F.array_join(F.transform(formal, lambda e: F.concat(e.key, F.lit(":\n"), e.value)), "\n"))
    reasoning = F.when(F.size(reasons) > 0, F.concat(F.lit("Reasoning:\n"), F.array_join(reasons, "\n")))
    formula = F.when((F.size(formal) > 0) & ~contains_text(answer, formal_text), formal_text)
    full = expand_answer(answer, options)
    labelled = F.when(full != "", F.when(F.isnotnull(reasoning) | F.isnotnull(formula), F.concat(F.lit("Answer:\n"), full)).otherwise(full))
    return strip(F.concat_ws("\n\n", reasoning, formula, labelled))


def symbols(text: Column) -> tuple[Column, Column]:
    """(entities, predicates) of formulas, sorted without case: names before a bracket are predicates, other small-letter names entities."""
    known = lambda name: F.array_contains(F.array(*map(F.lit, VARIABLES)), name) | F.lower(name).isin(*LOGIC_WORDS)
    by_case = lambda names: F.transform(F.array_sort(F.transform(F.array_distinct(names), lambda n: F.struct(F.lower(n).alias("l"), n.alias("n")))), lambda s: s.n)
    predicates = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)), lambda n: ~known(n))
    names = F.regexp_extract_all(text, F.lit(r"\b[A-Za-z_][A-Za-z0-9_]*\b"), F.lit(0))
    entities = F.filter(F.array_except(names, predicates), lambda n: ~known(n) & ~n.rlike("^[A-Z]"))
    return by_case(entities), by_case(predicates)


def formal_text(dialogue: Column) -> Column:
    """What a dialogue states as formal logic: its FOL blocks, else what follows "Formal logic:", else nothing."""
    blocks = F.regexp_extract_all(dialogue, F.lit(r"(?s)(?:premises-FOL|conclusion-FOL):\s*(.*?)(?:\n\n(?:Answer|Reasoning):|\z)"), F.lit(1))
    after = F.when(F.contains(dialogue, F.lit("Formal logic:")), F.substring_index(dialogue, "Formal logic:", -1)).otherwise("")
    return F.when(F.size(blocks) > 0, F.array_join(F.transform(blocks, strip), "\n")).otherwise(after)


def hyphen_compounds(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b[A-Za-z]+(?:-[A-Za-z]+)+\b"), F.lit(0))


def years(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b(?:18|19|20)[0-9]{2}\b"), F.lit(0)), lambda y: F.concat(F.lit("year"), y))


def contradictions(clauses: DataFrame, group: list[str]) -> DataFrame:
    """(group, proposition): propositions that a group states both plainly and negated. Counted, not paired."""
    both = clauses.groupBy(*group, "proposition").agg(F.max(F.col("negated").cast("int")).alias("hi"), F.min(F.col("negated").cast("int")).alias("lo"))
    return both.where("hi = 1 and lo = 0").drop("hi", "lo")


def _negated(clause: Column) -> Column:
    """The negation of a clause's JSON, without two signs on top."""
    return F.when(clause.startswith('["~",'), F.substring(clause, F.lit(6), F.length(clause) - 6)).otherwise(F.concat(F.lit('["~",'), clause, F.lit("]")))


def clause_text(clause: Column) -> Column:
    """A clause tree's JSON in one form: no white space, pairs of signs on top and below a quantifier on top taken out; null for what is no JSON array."""
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  a value that is named is reckoned once

    def without_signs(lead: str):
        def cut(plain: Column) -> Column:
            # An even number of signs says nothing: they go in front, and as many closing brackets at the end.
            front = F.regexp_extract(plain, f"^{lead}", 0) if lead else F.lit("")
            signs = F.regexp_extract(plain, f'^{lead}((?:\\["~",\\["~",)+)', 2 if lead else 1)
            body = F.substring(plain, F.length(front) + F.length(signs) + 1, F.length(plain) - F.length(front) - F.length(signs) - (F.length(signs) / 5).cast("int"))
            return F.concat(front, body)

        return cut

    plain = once(F.to_json(F.try_parse_json(clause)), lambda x: F.when(x.startswith("["), x))
    return once(once(plain, without_signs("")), without_signs(r'(\["~",)?\["(?:forall|exists|of)",'))


def clause_clashes(clauses: DataFrame, group: list[str], clause: str = "clause") -> DataFrame:
    """(group, clause, against): different clauses of a group that can't both hold, each pair from the side that denies.

    A clause denies what its negation says; one that holds of all (forall) also that its body's negation holds of some (exists) or of the constant (of),
    and that the body doesn't hold of those. Clauses are JSON trees; what each denies are at most five texts, joined by
    equality with what is stated, so a group of n clauses makes 5 n rows and not n^2. Null and broken clauses state nothing; repeated ones count once.
    """
    # Repeats go before trees are read.
    stated = clauses.select(*group, F.col(clause).alias("clause")).distinct().withColumn("clause", clause_text(F.col("clause"))).where("clause is not null").distinct()
    c = F.col("clause")
    body = F.when(c.startswith('["forall",'), F.substring(c, F.lit(11), F.length(c) - 11))
    wrap = lambda name, x: F.concat(F.lit(f'["{name}",'), x, F.lit("]"))
    denied = [_negated(c), *[wrap(q, _negated(body)) for q in ("exists", "of")], *[_negated(wrap(q, body)) for q in ("exists", "of")]]
    # Of a clause and its negation the plain one's denial is enough.
    first = F.when(~c.startswith('["~",'), denied[0])
    denials = stated.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], c.alias("_of"), F.explode(F.array_distinct(F.array_compact(F.array(first, *denied[1:])))).alias("against"))
    match = F.col("clause") == F.col("against")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return stated.join(denials, match).select(*group, F.col("_of").alias("clause"), "against")
