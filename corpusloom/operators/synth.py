"""Synthetic logic: clauses, rules of inference, one-step inference, problems by backward chaining, and examples, generated by seed.

A clause is a nested list: ["p"], ["~", c], ["and"|"or"|"->"|"<->", a, b]; over predicates also ["forall", c], ["exists", c] and
["of", c] (c of the constant a). Problems are generated by rows of seeds in Arrow batches, so that generation spreads over tasks and
repeats for equal seeds.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Clause = list[Any]
Step = tuple[list[Clause], Clause, str]

#: Rules of inference: premises; what follows; what contradicts it; what has nothing to do with it; their name.
PROPOSITIONAL = """
p -> q, p; q; ~q; r, ~r; modus ponens
p -> q, ~q; ~p; p; r, ~r; modus tollens
p -> ~q, q; ~p; p; r, ~r; modus tollens
p -> q, q; ; ; p; incorrect modus tollens
p -> q, q -> r; p -> r; ~(p -> r); p, q, r; transitivity
p or q, ~p; q; ~q; r, ~r; disjunctive syllogism
p; p or q; ~p; r, ~r; addition
p and q; p, q; ~p, ~q; r, ~r; simplification
p, q; p and q; ~p, ~q; p -> q; conjunction
p or q, ~p or r; q or r; ; q, r; resolution
p or ~q; q -> p; ; ; rewriting
p -> r, q -> r, p or q; r; ~r; s; disjunction elimination
p -> q, q -> p; p <-> q; ~(p <-> q); ; biconditional introduction
p <-> q; p -> q; ~(p -> q); ; biconditional elimination
p <-> q; q -> p; ~(q -> p); ; biconditional elimination
p <-> q, ~p; ~q; q; ; biconditional elimination
p <-> q, ~q; ~p; p; ; biconditional elimination
"""
#: The same of predicates.
QUANTIFIED = """
forall p; of p; ~of p; of q, ~of q; universal instantiation
of p; exists p; ; forall p, of q; existential generalization
"""
#: Shares of problems by steps tried, and of examples by type.
LENGTHS = (0.5, 0.25, 0.25)
TYPES = {"1": 0.5, "2a": 1.0, "2b": 0.75, "3a": 1.0, "3b": 0.75}
#: Of the problems at most such a share may have premises that contradict each other.
CONTRADICTORY = 0.1
NAMES = "pqrstuw"


@dataclass(frozen=True)
class Rule:
    premises: tuple[Clause, ...]
    follows: tuple[Clause, ...]
    against: tuple[Clause, ...]
    unrelated: tuple[Clause, ...]
    name: str


def parse(text: str) -> Clause:
    """A clause from its notation; "~" and words before a clause bind first, and there is at most one two-sided sign outside brackets."""
    marks = re.findall(r"<->|->|[~()]|\w+", text)

    def part() -> Clause:
        mark = marks.pop(0)
        if mark == "(":
            inner = whole()
            marks.pop(0)
            return inner
        return [mark, part()] if mark in ("~", "forall", "exists", "of") else [mark]

    def whole() -> Clause:
        left = part()
        return [marks.pop(0), left, part()] if marks and marks[0] != ")" else left

    return whole()


def parse_rules(text: str) -> list[Rule]:
    rules = []
    for line in text.strip().splitlines():
        *lists, name = (x.strip() for x in line.split(";"))
        rules.append(Rule(*(tuple(map(parse, filter(None, x.split(",")))) for x in lists), name))
    return rules


def negated(clause: Clause) -> Clause:
    return clause[1] if clause[0] == "~" else ["~", clause]


def universal(rule: Rule) -> Rule:
    """The rule for all x."""
    forall = lambda clauses: tuple(["forall", c] for c in clauses)
    return Rule(forall(rule.premises), forall(rule.follows), tuple(negated(["forall", c]) for c in rule.follows), forall(rule.unrelated), f"universal {rule.name}")


def existential(rule: Rule) -> list[Rule]:
    """For each premise, the rule with that premise and what follows of some x and the other premises of all x: it holds of the x there is."""
    out = []
    for i in range(len(rule.premises)):
        parts = tuple(["exists" if k == i else "forall", c] for k, c in enumerate(rule.premises))
        follows = tuple(["exists", c] for c in rule.follows)
        out.append(Rule(parts, follows, tuple(map(negated, follows)), tuple(["exists", c] for c in rule.unrelated), f"existential {rule.name}"))
    return out


RULES: list[Rule] = parse_rules(PROPOSITIONAL)


def quantified(rules: Sequence[Rule] = tuple(RULES)) -> list[Rule]:
    """Rules over predicates: the two of instances, and of each rule the universal and the existential ones."""
    return [*parse_rules(QUANTIFIED), *(v for rule in rules for v in (universal(rule), *existential(rule)))]


ALL_RULES: list[Rule] = [*RULES, *quantified()]


def unify(pattern: Clause, clause: Clause, bound: dict[str, Clause]) -> dict[str, Clause] | None:
    """Bindings of a pattern's letters that make it the clause, beyond those bound; None if there are none. A letter may be bound to a compound."""
    if len(pattern) == 1:
        known = bound.get(pattern[0])
        if known is None:
            return bound | {pattern[0]: clause}
        return bound if known == clause else None
    if len(clause) != len(pattern) or clause[0] != pattern[0]:
        return None
    for a, b in zip(pattern[1:], clause[1:], strict=True):
        if (bound := unify(a, b, bound)) is None:
            return None
    return bound


def bind(pattern: Clause, bound: dict[str, Clause]) -> Clause:
    if len(pattern) == 1:
        return bound.get(pattern[0], pattern)
    return [pattern[0], *[bind(x, bound) for x in pattern[1:]]]


def letters(pattern: Clause) -> set[str]:
    """The letters of a pattern or clause."""
    return {pattern[0]} if len(pattern) == 1 else set().union(*map(letters, pattern[1:]))


def in_order(clauses: Sequence[Clause]) -> list[str]:
    """The letters of clauses in order of appearance."""
    order: dict[str, None] = {}

    def visit(clause: Clause) -> None:
        if len(clause) == 1:
            order.setdefault(clause[0])
        for part in clause[1:]:
            visit(part)

    for clause in clauses:
        visit(clause)
    return list(order)


def name_for(i: int) -> str:
    return NAMES[i] if i < len(NAMES) else f"{NAMES[i % len(NAMES)]}{i // len(NAMES)}"


def renamed(clauses: list[Clause], names: Sequence[str] | None = None) -> list[Clause]:
    """Clauses with their letters renamed in order of appearance (to ``names`` where given): equal for problems that differ in names alone."""
    order = in_order(clauses)
    to = {name: [names[i] if names else name_for(i)] for i, name in enumerate(order)}
    return [bind(clause, to) for clause in clauses]


def contradicts(premises: Sequence[Clause], rules: Sequence[Rule] = ()) -> bool:
    """Whether one premise is the negation of another (by a set, not by pairs), holds of all what another denies of some, or contradicts what one of ``rules`` infers from others."""
    stated = {json.dumps(p) for p in premises}
    for p in premises:
        if json.dumps(["~", p]) in stated:
            return True
        # All x are p, and some or the constant isn't.
        if p[0] == "forall" and not stated.isdisjoint(json.dumps(c) for c in (["exists", negated(p[1])], ["of", negated(p[1])], ["~", ["of", p[1]]], ["~", ["exists", p[1]]])):
            return True
    return any(json.dumps(bind(a, bound)) in stated for rule in rules for bound, _ in matches(rule, premises) for a in rule.against if letters(a) <= bound.keys())


def matches(rule: Rule, premises: Sequence[Clause]) -> list[tuple[dict[str, Clause], list[Clause]]]:
    """(bindings, premises used) of every way in which the rule's premises match different premises."""
    ways: list[tuple[dict[str, Clause], list[Clause]]] = [({}, [])]
    for pattern in rule.premises:
        ways = [(b, [*used, p]) for bound, used in ways for p in premises if p not in used and (b := unify(pattern, p, bound)) is not None]
    return ways


def firings(premises: Sequence[Clause], rules: Sequence[Rule] = tuple(RULES)) -> list[tuple[str, list[Clause], Clause]]:
    """(rule, premises used, inference) of every way in which a rule's premises match. Inferences that are premises already, or that bring in letters of their own, are left out."""
    known, out = {json.dumps(p) for p in premises}, {}
    for rule in rules:
        for bound, used in matches(rule, premises):
            for inference in (bind(f, bound) for f in rule.follows if letters(f) <= bound.keys()):
                if json.dumps(inference) not in known:
                    out.setdefault((rule.name, json.dumps(inference)), (rule.name, used, inference))
    return list(out.values())


def render(clause: Clause, of: str = "") -> str:
    """Logic notation; a letter under a quantifier is a predicate of x."""
    if len(clause) == 1:
        return f"{clause[0].upper()}({of})" if of else clause[0]
    if clause[0] == "~":
        return f"~{render(clause[1], of)}"
    if clause[0] in ("forall", "exists"):
        return f"{clause[0]} x: {render(clause[1], 'x')}"
    if clause[0] == "of":
        return render(clause[1], "a")
    return f"({render(clause[1], of)} {clause[0]} {render(clause[2], of)})"


#: What letters say in English: of nobody, and of someone.
_FACTS = ["it rains", "the train is late", "the shop is open", "the lamp is on", "the road is closed", "the bell rings", "the river is high"]
_TRAITS = ["sings", "owns a boat", "likes tea", "reads at night", "works in town", "keeps bees", "rides to school"]


def proposition(letter: str, of: str = "") -> str:
    """English for a letter (of someone); further letters get a number."""
    i = NAMES.index(letter[0]) if letter[0] in NAMES else 0
    said = f"{of} {_TRAITS[i]}" if of else _FACTS[i]
    return f"{said} on day {letter[1:]}" if letter[1:] else said


def say(clause: Clause, of: str = "") -> str:
    """English for a clause. Of some x what holds of it and what doesn't is said of one and the same."""
    if len(clause) == 1:
        return proposition(clause[0], of)
    if clause[0] == "~":
        return f"it is not the case that {say(clause[1], of)}"
    if clause[0] == "forall":
        return f"for every person, {say(clause[1], 'that person')}"
    if clause[0] == "exists":
        inner = clause[1]
        if inner[0] == "and":
            return f"there is someone of whom it is true that {say(inner[1], 'that person')} and also that {say(inner[2], 'that person')}"
        return f"there is someone of whom it is true that {say(inner, 'that person')}"
    if clause[0] == "of":
        return say(clause[1], "Anna")
    a, b = say(clause[1], of), say(clause[2], of)
    return {"and": f"{a} and {b}", "or": f"{a} or {b}", "->": f"if {a}, then {b}", "<->": f"{a} if and only if {b}"}[clause[0]]


@dataclass
class Problem:
    """Premises; what they imply and what contradicts them, each with its chain of (premises, inference, rule); what has nothing to do with them."""

    premises: list[Clause]
    inferences: list[tuple[Clause, list[Step]]] = field(default_factory=list)
    against: list[tuple[Clause, list[Step]]] = field(default_factory=list)
    unrelated: list[Clause] = field(default_factory=list)
    contradiction: bool = False

    @property
    def length(self) -> int:
        return max((len(chain) for _, chain in [*self.inferences, *self.against]), default=0)

    @property
    def rules(self) -> list[str]:
        return list(dict.fromkeys(step[2] for _, chain in [*self.inferences, *self.against] for step in chain))

    def text(self) -> str:
        return json.dumps([self.premises, self.inferences, self.against, self.unrelated])


def shortened(problem: Problem) -> Problem:
    """Chains end with the first step after which their clause is known, or contradicted."""

    def cut(clause: Clause, chain: list[Step], done: Any) -> list[Step]:
        known = list(problem.premises)
        for n in range(len(chain) + 1):
            if done(clause, known):
                return chain[:n]
            known += [chain[n][1]] if n < len(chain) else []
        return chain

    follows = [(c, cut(c, chain, lambda clause, known: clause in known)) for c, chain in problem.inferences]
    against = [(c, cut(c, chain, lambda clause, known: contradicts([*known, clause]))) for c, chain in problem.against]
    return Problem(problem.premises, follows, against, problem.unrelated, problem.contradiction)


def rebound(problem: Problem, bound: dict[str, Clause]) -> Problem:
    """The problem with its letters bound."""
    every = lambda clauses: [bind(c, bound) for c in clauses]
    chain = lambda steps: [(every(p), bind(c, bound), name) for p, c, name in steps]
    told = lambda pairs: [(bind(c, bound), chain(steps)) for c, steps in pairs]
    return Problem(every(problem.premises), told(problem.inferences), told(problem.against), every(problem.unrelated), problem.contradiction)


def canonical(problem: Problem) -> Problem:
    """Letters renamed in order of appearance."""
    found = in_order([*problem.premises, *(c for c, _ in [*problem.inferences, *problem.against]), *problem.unrelated])
    return rebound(problem, {name: [name_for(i)] for i, name in enumerate(found)})


def variation(problem: Problem, rng: random.Random) -> Problem:
    """Letters renamed at random, and premises in another order."""
    found = in_order([*problem.premises, *(c for c, _ in [*problem.inferences, *problem.against]), *problem.unrelated])
    names = [name_for(i) for i in range(max(len(found), len(NAMES)))]
    out = rebound(problem, {name: [to] for name, to in zip(found, rng.sample(names, len(found)), strict=True)})
    rng.shuffle(out.premises)
    return out


def problem(seed: int, lengths: Sequence[float] = LENGTHS) -> Problem:
    """A rule's premises, and up to as many times as drawn by ``lengths`` a premise replaced by the premises of a rule that infers it."""
    rng = random.Random(seed)
    tries = rng.choices(range(len(lengths)), lengths)[0]
    fresh = iter(range(10_000))

    def instance(rule: Rule) -> Rule:
        used = in_order([*rule.premises, *rule.follows, *rule.against, *rule.unrelated])
        to = {x: [f"z{next(fresh)}"] for x in used}
        return Rule(*(tuple(bind(c, to) for c in part) for part in (rule.premises, rule.follows, rule.against, rule.unrelated)), rule.name)

    # Propositional rules are fewer, so half the draws are of them alone.
    rule = instance(rng.choice(RULES if rng.random() < 0.5 else ALL_RULES))
    steps: list[Step] = [(list(rule.premises), f, rule.name) for f in rule.follows]
    made = Problem(list(rule.premises), [(f, [s]) for f, s in zip(rule.follows, steps, strict=True)], [(a, steps[:1]) for a in rule.against], list(rule.unrelated))
    for _ in range(tries):
        target = rng.choice(made.premises)
        options = []
        for r in map(instance, ALL_RULES):
            for f in r.follows:
                if len(f) > 1 or r.name in ("modus ponens", "simplification", "disjunction elimination"):
                    bound = unify(f, target, {})
                    if bound is not None:
                        options.append((r, f, bound))
        if not options:
            continue
        r, f, bound = rng.choice(options)
        needed = [bind(c, bound) for c in r.premises]
        step = (needed, target, r.name)
        made = Problem(
            [*(p for p in made.premises if p != target), *(n for n in needed if n not in made.premises)],
            [(c, [step, *chain]) for c, chain in made.inferences],
            [(c, [step, *chain]) for c, chain in made.against],
            made.unrelated,
        )
    made.contradiction = contradicts(made.premises, ALL_RULES)
    return canonical(shortened(made))


def _derived(chain: list[Step], show: Any, name_rule: bool, join: str) -> str:
    """The chain in words, a sentence a step."""
    out = []
    for i, (premises, inference, rule) in enumerate(chain):
        begin = "Finally, from" if i and i == len(chain) - 1 else "From"
        via = f" via {rule}" if name_rule else ""
        out.append(f"{begin} {join.join(map(show, premises))} we can infer {show(inference)}{via}.")
    return " ".join(out)


def example(made: Problem, kind: str, rng: random.Random) -> tuple[str, str, str]:
    """(type, inputs, targets). Type 1: translate an inference to logic notation. 2a, 2b: what follows in one step. 3a, 3b: does a clause follow, and how. a: in notation, b: in English.

    A type with "-empty" or "-cont" tells that nothing follows or that the premises contradict each other.
    """
    show = render if kind.endswith("a") else say
    told = ". ".join(map(show, made.premises))
    if kind == "1":
        if not made.inferences:
            return "", "", ""
        found, _ = rng.choice(made.inferences)
        english = ". ".join(map(say, made.premises))
        return kind, f"Write this inference in logic notation: {english}. Therefore {say(found)}.", f"{'. '.join(map(render, made.premises))}. Therefore {render(found)}."
    name_rule = rng.random() < 0.5
    asked = " Name the rules of inference used." if name_rule else ""
    if kind[0] == "2":
        found = sorted(firings(made.premises, ALL_RULES), key=lambda f: (f[0], json.dumps(f[2])))
        inputs = f"What follows from these premises in a single step, without new predicates or constants?{asked} {told}."
        if made.contradiction:
            return f"{kind}-cont", inputs, "The premises contradict each other, so anything follows."
        if not found:
            return f"{kind}-empty", inputs, "Nothing follows from these premises."
        return kind, inputs, " ".join(f"{show(c)}{f' by {name}' if name_rule else ''}." for name, _, c in found)
    choices = [(c, chain, "yes") for c, chain in made.inferences] + [(c, chain, "no") for c, chain in made.against]
    choices += [(c, [], "unknown") for c in (rng.sample(made.unrelated, 1) if made.unrelated else [])]
    if rng.random() < 0.1:
        choices += [(p, [], "yes") for p in made.premises]
    if not choices:
        return "", "", ""
    clause, chain, verdict = rng.choice(choices)
    inputs = f"Consider these premises. {told}. Does this follow from them: {show(clause)}?{asked}"
    how = _derived(chain, show, name_rule, ", " if kind == "3a" else ", and that ")
    if made.contradiction:
        return f"{kind}-cont", inputs, "The premises contradict each other, so anything follows. Therefore the answer is yes."
    if verdict == "yes":
        return kind, inputs, f"{how or 'That is one of the premises.'} Therefore the answer is yes."
    if verdict == "no":
        return kind, inputs, f"{how} That contradicts {show(clause)}. Therefore the answer is no." if how else "That contradicts the premises. Therefore the answer is no."
    return kind, inputs, "That doesn't follow from the premises. Therefore the answer is no."


def problems(spark: SparkSession, seeds: int, first: int = 0, lengths: Sequence[float] = LENGTHS) -> DataFrame:
    """(seed, key, contradiction, chain_length, n_premises, rules): the distinct problems of the seeds, smallest seed first.

    Of those whose premises contradict each other only so many stay, in order of a hash of the seed, as are CONTRADICTORY of the others and they together.
    """
    schema = "seed long, key string, contradiction boolean, chain_length int, n_premises int, rules array<string>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                seen = batch.column(0).slice(at, 1000).to_pylist()
                made = [problem(s, lengths) for s in seen]
                columns = [pa.array(seen), pa.array([m.text() for m in made]), pa.array([m.contradiction for m in made]), pa.array([m.length for m in made], pa.int32())]
                columns += [pa.array([len(m.premises) for m in made], pa.int32()), pa.array([m.rules for m in made], pa.list_(pa.string()))]
                yield pa.record_batch(columns, names=[x.split()[0] for x in schema.split(", ")])

    every = spark.range(first, first + seeds).mapInArrow(work, schema)
    distinct = every.groupBy("key").agg(F.min_by(F.struct("seed", "contradiction", "chain_length", "n_premises", "rules"), "seed").alias("m"))
    distinct = distinct.select("m.seed", "key", "m.contradiction", "m.chain_length", "m.n_premises", "m.rules")
    counts = distinct.agg(F.count_if("contradiction").alias("_c"), F.count_if(~F.col("contradiction")).alias("_s"))
    share = F.floor(F.col("_s") * (CONTRADICTORY / (1 - CONTRADICTORY))) / F.greatest("_c", F.lit(1))
    drawn = F.pmod(F.xxhash64("seed", F.lit(1)), F.lit(1 << 20)) / float(1 << 20)
    return distinct.crossJoin(F.broadcast(counts)).where(~F.col("contradiction") | (drawn < share)).drop("_c", "_s")  # counts is one row


def examples(spark: SparkSession, seeds: int, first: int = 0, lengths: Sequence[float] = LENGTHS, variations: int = 1, types: dict[str, float] | None = None) -> DataFrame:
    """(seed, example_type, inputs, targets, chain_length, n_premises, contradiction, rules): for each problem and variation an example of a type drawn by its share; distinct by text, smallest seed first."""
    shares = types or TYPES
    schema = "seed long, example_type string, inputs string, targets string, chain_length int, n_premises int, contradiction boolean, rules array<string>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for seed in batch.column(0).to_pylist():
                base = problem(seed, lengths)
                for k in range(variations):
                    rng = random.Random(f"{seed}-{k}")
                    made = variation(base, rng) if k else base
                    kind, inputs, targets = example(made, rng.choices(list(shares), list(shares.values()))[0], rng)
                    if kind:
                        rows.append((seed, kind, inputs, targets, made.length, len(made.premises), made.contradiction, made.rules))
            kinds = [pa.int64(), *[pa.string()] * 3, pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string())]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    made = problems(spark, seeds, first, lengths).select("seed").mapInArrow(work, schema)
    rest = [c for c in made.columns if c != "inputs"]
    return made.groupBy("inputs").agg(F.min_by(F.struct(*rest), F.struct("seed", "example_type")).alias("e")).select("inputs", *[f"e.{c}" for c in rest])


def split_iid(df: DataFrame, train_ratio: float = 0.9) -> DataFrame:
    """split by hash of the seed, so that a problem's examples stay together."""
    share = F.pmod(F.xxhash64("seed"), F.lit(10_000)) / 10_000.0
    return df.withColumn("split", F.when(share < train_ratio, "train").otherwise("test"))


def rule_counts(df: DataFrame) -> DataFrame:
    """(rule, n): how many examples or problems use each rule, with a zero for rules not used."""
    names = df.sparkSession.createDataFrame([(name,) for name in sorted({r.name for r in ALL_RULES})], "rule string")
    used = df.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return names.join(used, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


def type_counts(df: DataFrame) -> DataFrame:
    """(example_type, n): examples by type, with a zero for types not made."""
    names = [f"{t}{end}" for t in TYPES for end in (("",) if t == "1" else ("", "-empty", "-cont") if t[0] == "2" else ("", "-cont"))]
    every = df.sparkSession.createDataFrame([(n,) for n in names], "example_type string")
    return every.join(df.groupBy("example_type").agg(F.count(F.lit(1)).alias("n")), "example_type", "left").select("example_type", F.coalesce("n", F.lit(0)).alias("n"))


def split_ood(df: DataFrame, train_ratio: float = 0.9) -> DataFrame:
    """split by what problems are built of: all examples with one sequence of rules are on one side."""
    share = F.pmod(F.xxhash64(F.array_join("rules", "|")), F.lit(10_000)) / 10_000.0
    return df.withColumn("split", F.when(share < train_ratio, "train").otherwise("test"))


def split_length(df: DataFrame, most: int) -> DataFrame:
    """split: problems of up to ``most`` premises are train, those of more test."""
    return df.withColumn("split", F.when(F.col("n_premises") <= most, "train").otherwise("test"))


def uncovered_rules(df: DataFrame) -> DataFrame:
    """(rule): rules that test examples use and no training example does; empty for a sound split."""
    used = df.select("split", F.explode("rules").alias("rule"))
    return used.where("split = 'test'").select("rule").distinct().join(used.where("split = 'train'"), "rule", "left_anti")
