"""Level and experience rules over a table of offers, with the evidence of every decision.

The Unicode matching form and the technology aliases come from small Arrow UDFs. All rules are native
column expressions over arrays of one row, so classifying moves no data: the job is one scan.

Input columns: title, description_text, experience_required (boolean), experience_label, salary_label.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.text import SEPARATOR, source_offset, trim_text
from offerlens.operators.technologies import FIELDS, selected_hits, technology_slugs, text_forms
from offerlens.rules import patterns as P
from offerlens.sources.tables import computed_once

CLASSIFIER_VERSION = "classifier-1.3.7"
OBSERVATION_VERSION = "junior-observation-2.0.0"
TEXT_FIELDS = FIELDS
ACCEPTANCE_RULES = ("BEGINNER_ACCEPTED_BODY", "BEGINNER_ACCEPTED_STRUCTURED")
COHERENCE_CONFLICTS = ("BEGINNER_EXPERIENCE_CONFLICT", "STRUCTURED_EXPERIENCE_CONFLICT", "STRUCTURED_DURATION_CONFLICT")
EVIDENCE = "array<struct<kind:string,rule_id:string,field:string,excerpt:string,start:int,end:int,normalized_value:string>>"
_ALL = 2**31 - 1


_BUILT: dict[str, tuple[str, dict[str, Column]]] = {}


def _built(name: str, build: Callable[[], dict[str, Column]]) -> dict[str, Column]:
    """Columns of one step. They name their inputs only, so they are built once per application; one is kept a step."""
    application = SparkContext.getOrCreate().applicationId
    if _BUILT.get(name, ("",))[0] != application:
        _BUILT[name] = (application, build())
    return _BUILT[name][1]


def _proof(kind, rule, field: str, excerpt: Column, start: Column, end: Column, value=None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return F.struct(
        lit(kind).alias("kind"),
        lit(rule).alias("rule_id"),
        F.lit(field).alias("field"),
        excerpt.alias("excerpt"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        lit(value).alias("normalized_value"),
    )


class _Text:
    """One text field of the offer: its source, matching form and offsets."""

    def __init__(self, field: str, source: Column, form: Column):
        self.field, self.source = field, source
        self.marked, self.shifts = form["marked"], form["shifts"]

    def first(self, pattern: str, literals: tuple[str, ...] = ()) -> Column:
        """First match as struct(start, hit) in the matching form, or null."""
        return F.when(_any_literal(self.marked, literals), _located(self.marked, pattern))

    def proof(self, kind, rule, start: Column, size: Column, value=None) -> Column:
        begin = source_offset(self.shifts, start)
        end = source_offset(self.shifts, F.greatest(start, start + size - 1)) + 1
        excerpt = F.substring(self.source, begin + 1, end - begin)
        return _proof(kind, rule, self.field, excerpt, begin, end, value)

    def proof_of(self, kind, rule, match: Column, value=None) -> Column:
        """Evidence of a `first` match; null when there is none."""
        return F.when(match.isNotNull(), self.proof(kind, rule, match["start"], F.length(match["hit"]), value))


def _located(text: Column, pattern: str) -> Column:
    """First match as struct(start, hit), or null; the text is read once."""
    cut = F.filter(F.array(F.split(text, pattern, 2)), lambda parts: F.size(parts) > 1)

    def place(parts: Column) -> Column:
        start = F.length(parts[0])
        size = F.length(text) - start - F.length(parts[1])
        return F.struct(start.alias("start"), F.substring(text, start + 1, size).alias("hit"))

    return F.get(F.transform(cut, place), 0)


def _any_literal(text: Column, literals: tuple[str, ...]) -> Column:
    """A cheap test which a text must pass before its regular expressions run."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in literals]) if literals else F.lit(True)


def _texts() -> dict[str, _Text]:
    sources = {"title": "title", "description": "description_text", "experienceLabel": "_label"}
    return {f: _Text(f, F.col(sources[f]), F.col(f"_form_{f}")) for f in TEXT_FIELDS}


def matching_forms(offers: DataFrame) -> DataFrame:
    """Add the matching form of every text; one UDF makes them all in one pass over the batches."""
    offers = offers.withColumn("_label", F.coalesce("experience_label", F.lit("")))
    offers = offers.withColumn("_salary", trim_text(F.col("salary_label")))
    offers = offers.withColumn("_forms", text_forms("title", "description_text", "_label", "_salary"))
    for field in TEXT_FIELDS:
        offers = offers.withColumn(f"_form_{field}", F.col("_forms")[field])
    return offers.withColumn("_hits", F.col("_forms")["hits"]).withColumn("_form_salary", F.col("_forms")["salary"])


# ---------------------------------------------------------------- salary and remote mode


def salary_transparent(label: Column) -> Column:
    """An amount, a period and a currency are all named; vague wording has no amount and so fails."""
    named = [P.SALARY_AMOUNT, P.SALARY_PERIOD, P.SALARY_CURRENCY]
    found = [F.rlike(label, F.lit(p)) for p in named]
    return F.coalesce(found[0] & found[1] & found[2], F.lit(False))


def _first_source(source: Column, field: str, mode: str) -> Column:
    found = F.array_compact(F.array(_located(source, P.remote_rx(mode))))

    def proof(m: Column) -> Column:
        return _proof("remote", P.REMOTE_RULES[mode], field, m["hit"], m["start"], m["start"] + F.length(m["hit"]), mode)

    return F.get(F.transform(found, proof), 0)


def remote_evidence(title: Column, description: Column, folded: Column | None = None) -> Column:
    """First match of each mode in title and description; `folded` is a lower-case form of the description."""
    proofs = [_first_source(title, "title", mode) for mode in P.REMOTE]
    for mode in P.REMOTE:
        possible = F.lit(True) if folded is None else _any_literal(folded, P.REMOTE_LITERALS[mode])
        proofs.append(F.when(possible, _first_source(description, "description", mode)))
    return F.array_compact(F.array(*proofs))


def remote_mode(evidence: Column) -> Column:
    """Exactly one mode is believed."""
    modes = F.array_distinct(F.transform(evidence, lambda e: e["normalized_value"]))
    return F.when(F.size(modes) == 1, modes[0]).otherwise("unknown")


def remote_warning(evidence: Column) -> Column:
    modes = F.array_distinct(F.transform(evidence, lambda e: e["normalized_value"]))
    vague = F.exists(evidence, lambda e: F.rlike(e["excerpt"], F.lit(P.REMOTE_POSSIBLE)))
    return F.when(F.size(modes) > 1, "REMOTE_SIGNALS_CONFLICT").when((F.size(modes) == 1) & vague, "REMOTE_FREQUENCY_UNKNOWN")


# ---------------------------------------------------------------- durations


def duration_pieces(marked: Column) -> Column:
    """The text cut at its durations, as text, duration, text, ...; one element when there is none."""
    return F.split(F.regexp_replace(marked, f"({P.MENTION})", f"{SEPARATOR}$1{SEPARATOR}"), SEPARATOR)


def experience_mentions(pieces: Column) -> Column:
    """Durations of a text: array of (rank, start, rule_id, text, outer).

    A range also gives the single duration at its end, with the start of the range as `outer`; it counts
    only when the range is not taken.
    """
    count = F.floor(F.size(pieces) / 2).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.struct(pieces[i * 2].alias("gap"), pieces[i * 2 + 1].alias("token"))
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,token:string>>").alias("out"))

    def place(done: Column, pair: Column) -> Column:
        begin = done["at"] + F.length(pair["gap"])
        entry = F.struct(begin.alias("start"), pair["token"].alias("token"))
        return F.struct(
            (begin + F.length(pair["token"])).alias("at"), F.concat(done["out"], F.array(entry)).alias("out")
        )

    placed = F.aggregate(pairs, start, place, lambda done: done["out"])
    none = F.lit(None).cast("int")

    def mention(rank: int, rule: str, begin: Column, text: Column, outer: Column) -> Column:
        return F.struct(
            F.lit(rank).alias("rank"),
            begin.alias("start"),
            F.lit(rule).alias("rule_id"),
            text.alias("text"),
            outer.alias("outer"),
        )

    def kinds(p: Column) -> Column:
        text, begin = p["token"], p["start"]
        inner = F.regexp_extract(text, P.DURATION, 0)
        ranged = mention(0, "EXP_RANGE_YEARS", begin, text, none)
        within = mention(1, "EXP_SINGLE_DURATION", begin + F.length(text) - F.length(inner), inner, begin)
        return (
            F.when(text.startswith("qualifications"), F.array(mention(2, "EXP_PROFILE_STACK", begin, text, none)))
            .when(F.rlike(text, F.lit(rf"^{P.RANGE}\z")), F.when(inner != "", F.array(ranged, within)).otherwise(F.array(ranged)))
            .otherwise(F.array(mention(1, "EXP_SINGLE_DURATION", begin, text, none)))
        )

    mentions = F.flatten(F.transform(placed, kinds))
    return F.when(F.size(pieces) > 1, F.array_sort(mentions))


def _calm(pieces: Column) -> Column:
    """The text with line ends inside durations turned into spaces: they do not end a clause."""
    parts = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.translate(p, "\n", " ")).otherwise(p))
    return F.when(F.size(pieces) > 1, F.array_join(parts, ""))


def _clauses(calm: Column) -> Column:
    return reduce(lambda text, mark: F.replace(text, F.lit(mark), F.lit(SEPARATOR)), P.BOUNDARY_MARKS, calm)


def _surroundings(calm: Column, clauses: Column, mention: Column) -> Column:
    """The mention with the texts around it."""
    begin, text = mention["start"], mention["text"]
    end = begin + F.length(text)
    far = F.least(begin, F.lit(400))
    return F.struct(
        mention["rank"].alias("rank"),
        mention["start"].alias("start"),
        mention["rule_id"].alias("rule_id"),
        text.alias("text"),
        mention["outer"].alias("outer"),
        F.substring(calm, begin - far + 1, far).alias("far_before"),
        F.substring(calm, end + 1, F.lit(70)).alias("near_after"),
        F.substring_index(F.substring(clauses, F.lit(1), begin), SEPARATOR, -1).alias("clause_before"),
        F.substring_index(F.substring(clauses, end + 1, F.lit(_ALL)), SEPARATOR, 1).alias("clause_after"),
    )


def _between_durations(m: Column) -> Column:
    """Cut the clause at the neighbouring durations: their requirement cannot qualify this one."""
    beyond = F.split(m["clause_after"], P.DURATION, 2)[0]
    before = F.element_at(F.split(m["clause_before"], P.DURATION), -1)
    kept = [m[c].alias(c) for c in ("rank", "start", "rule_id", "text", "outer", "far_before", "near_after", "clause_before", "clause_after")]
    return F.struct(
        *kept,
        F.right(before, F.lit(70)).alias("before"),
        F.left(beyond, F.lit(70)).alias("after"),
        beyond.alias("until_next"),
        F.concat(F.right(before, F.lit(70)), m["text"], F.left(beyond, F.lit(70))).alias("around"),
    )


def _like(value: Column, pattern: str) -> Column:
    return F.rlike(value, F.lit(P.rx(pattern)))


def _judged(field: str, m: Column) -> Column:
    """The signals of one mention."""
    before, after, around = m["before"], m["after"], m["around"]
    applicant = _like(before, P.APPLICANT)
    employer = (
        (~applicant & _like(m["far_before"], P.EMPLOYER_PITCH) & _like(after, P.EMPLOYER_PROJECTS))
        | (~applicant & _like(m["clause_after"], P.EMPLOYER_POSITION))
        | _like(before, P.EMPLOYER_FOUNDED)
        | (~applicant & _like(before, P.EMPLOYER_NAMED))
        | (_like(before, P.SHE_HAS) & _like(F.right(m["far_before"], F.lit(250)), P.EMPLOYER_WORD))
        | (~applicant & _like(m["clause_before"], P.EMPLOYER_MAJOR))
    )
    negated = _like(before, P.NOT_NEEDED)
    alternative = _like(m["clause_after"], P.BEGINNER_ALTERNATIVE)
    on_label = F.lit(field == "experienceLabel")
    subject = (
        (m["rule_id"] == "EXP_PROFILE_STACK")
        | _like(after, P.STACK_MINIMUM)
        | on_label
        | _like(around, P.EXPERIENCE)
        | _like(before, P.APPLICANT_MINIMUM)
    )
    near_before = F.right(m["far_before"], F.lit(70))
    excluded = (
        employer
        | negated
        | alternative
        | ~subject
        | _like(near_before, P.OTHER_SUBJECT)
        | _like(F.concat(near_before, m["text"], m["near_after"]), P.TEAM_SIZE)
        | _like(F.concat(m["clause_before"], m["text"], m["clause_after"]), P.STRONG_OF)
    )
    wished = _like(around, P.DESIRED)
    strong = on_label | _like(around, P.REQUIRED)
    desired = _like(before, P.PREFERENCE) | _like(m["until_next"], P.TRAILING_PREFERENCE) | (wished & ~strong)
    required = ~desired & (strong | (~wished & _like(around, P.GENERIC_REQUIRED)))
    amount = F.regexp_extract(m["text"], rf"^(?:qualifications)?{P.AMOUNT}", 1)
    words = F.create_map(*[x for w, n in P.NUMBER_WORDS.items() for x in (F.lit(w), F.lit(n))])
    number = F.coalesce(F.try_element_at(words, amount), F.when(F.rlike(amount, F.lit(r"^\d+$")), amount).cast("int"), F.lit(0))
    months = F.when(m["text"].contains("mois"), number).otherwise(number * 12)
    return F.struct(
        m["start"].alias("start"),
        m["rule_id"].alias("rule_id"),
        F.length(m["text"]).alias("size"),
        m["outer"].alias("outer"),
        F.when(negated, "EXP_NEGATED_DURATION").when(employer, "EXP_EMPLOYER_HISTORY").alias("excluded_by"),
        alternative.alias("alternative"),
        F.when(~excluded & desired, "desired").when(~excluded & required, "required").alias("verdict"),
        months.cast("string").alias("months"),
    )


def _judged_mentions(df: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """Add the judged mentions of some texts; each step is a column so that it is computed once."""

    def column(step: str, build: Callable[[str], Column]) -> dict[str, Column]:
        return {f"_{step}_{f}": _built(f"{step}/{f}", lambda: {step: build(f)})[step] for f in fields}

    def judged(f: str) -> Column:
        calm, clauses = F.col(f"_calm_{f}"), F.col(f"_clauses_{f}")
        around = F.transform(f"_mentions_{f}", lambda m: _surroundings(calm, clauses, m))
        return F.transform(F.transform(around, _between_durations), lambda m: _judged(f, m))

    df = df.withColumns(column("pieces", lambda f: duration_pieces(_texts()[f].marked)))
    df = df.withColumns(
        column("mentions", lambda f: experience_mentions(F.col(f"_pieces_{f}"))) | column("calm", lambda f: _calm(F.col(f"_pieces_{f}")))
    )
    df = df.withColumns(column("clauses", lambda f: _clauses(F.col(f"_calm_{f}"))))
    return df.withColumns(column("judged", judged))


def _duration_evidence(text: _Text, judged: Column) -> Column:
    taken = F.transform(
        F.filter(judged, lambda j: (j["rule_id"] == "EXP_RANGE_YEARS") & j["verdict"].isNotNull()), lambda j: j["start"]
    )
    live = F.filter(judged, lambda j: j["outer"].isNull() | ~F.array_contains(taken, F.coalesce(j["outer"], F.lit(-1))))

    def proofs(j: Column) -> Column:
        make = lambda kind, rule, value=None: text.proof(kind, rule, j["start"], j["size"], value)
        kind = F.when(j["verdict"] == "desired", "desired_experience").otherwise("required_experience")
        rule = F.when(j["verdict"] == "desired", "EXP_DESIRED_ONLY").otherwise(j["rule_id"])
        return F.array_compact(
            F.array(
                F.when(j["excluded_by"].isNotNull(), make("exclusion", j["excluded_by"])),
                F.when(j["alternative"], make("exclusion", "EXP_BEGINNER_ALTERNATIVE")),
                F.when(j["verdict"].isNotNull(), make(kind, rule, j["months"])),
            )
        )

    return F.coalesce(F.flatten(F.transform(live, proofs)), F.array().cast(EVIDENCE)).cast(EVIDENCE)


# ---------------------------------------------------------------- level


def _word(pattern: str) -> str:
    return P.rx(f"{P.WORD_START}(?:{pattern})")


def _level_columns() -> dict[str, Column]:
    t = _texts()
    title, body, label = (t[f] for f in TEXT_FIELDS)
    negative = P.rx(P.word(P.NOT_JUNIOR))
    body_rx, open_rx = _word(P.JUNIOR_BODY) + r"(?!\p{L})", P.rx(P.WORD_START + P.JUNIOR_OPENING + P.NO_LETTER)
    found = {
        "_no_title": title.first(negative),
        "_no_description": body.first(negative, ("junior",)),
        "_junior_title": title.first(_word(P.JUNIOR_TITLE) + r"(?!\p{L})"),
        "_senior_title": title.first(_word(P.SENIOR_TITLE) + r"(?!\p{L})"),
        "_senior_role": F.coalesce(*[body.first(P.rx(p), P.SENIOR_LITERALS) for p in P.SENIOR_ROLES]),
    }
    for text in (body, label):
        claim = F.coalesce(text.first(body_rx, P.JUNIOR_LITERALS), text.first(open_rx, ("junior",)))
        found[f"_junior_{text.field}"] = claim
    return found


def level_matches(df: DataFrame) -> DataFrame:
    """First matches of the level patterns, one struct column each."""
    return df.withColumns(_built("levels", _level_columns))


def _months(evidence: Column, where) -> Column:
    return F.transform(
        F.filter(evidence, lambda e: (e["kind"] == "required_experience") & where(e)), lambda e: e["normalized_value"].cast("int")
    )


def _enriched_columns() -> dict[str, Column]:
    """Salary, remote mode and technologies."""
    title, body = F.col("title"), F.col("description_text")
    return {
        "salary_transparent": salary_transparent(F.col("_form_salary")["marked"]),
        "_remote": remote_evidence(title, body, _texts()["description"].marked).cast(EVIDENCE),
        "_selected": selected_hits(F.col("_hits")),
    }


def _claim_columns() -> dict[str, Column]:
    """Evidence that stands before the durations. A negated level in title or body silences the texts' claims."""
    title, body, label = (_texts()[f] for f in TEXT_FIELDS)
    salary = _proof("salary", "SALARY_EXPLICIT_STRUCTURED", "salaryLabel", F.col("_salary"), F.lit(0), F.length("_salary"), "true")
    sources = F.array(F.col("title"), F.col("description_text"), F.col("_label"))
    names = F.array(*[F.lit(f) for f in FIELDS])
    mentions = F.transform(
        "_selected",
        lambda s: F.struct(
            F.lit("technology").alias("kind"),
            F.lit("TECHNOLOGY_ALIAS_MENTION").alias("rule_id"),
            names[s["field"]].alias("field"),
            F.substring(sources[s["field"]], s["start"] + 1, s["end"] - s["start"]).alias("excerpt"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["slug"].alias("normalized_value"),
        ),
    )
    denied = F.col("_no_title").isNotNull() | F.col("_no_description").isNotNull()

    def body_claim(text: _Text) -> Column:
        match = F.col(f"_junior_{text.field}")
        accepts = F.rlike(match["hit"], F.lit(P.rx(P.BEGINNER_ACCEPTED)))
        rule = F.when(accepts, "BEGINNER_ACCEPTED_BODY").otherwise("JUNIOR_EXPLICIT_BODY")
        return F.when(~denied, text.proof_of("junior_claim", rule, match, "true"))

    structured = label.proof("junior_claim", "BEGINNER_ACCEPTED_STRUCTURED", F.lit(0), F.length(label.marked), "true")
    levels = F.array_compact(
        F.array(
            title.proof_of("exclusion", "NEGATED_JUNIOR", F.col("_no_title")),
            body.proof_of("exclusion", "NEGATED_JUNIOR", F.col("_no_description")),
            F.when(~denied, title.proof_of("junior_claim", "JUNIOR_EXPLICIT_TITLE", F.col("_junior_title"), "true")),
            body_claim(body),
            body_claim(label),
            F.when(F.col("experience_required") == F.lit(False), structured),
        )
    )
    return {
        "_first": F.concat(
            F.when(F.col("salary_transparent"), F.array(salary)).otherwise(F.array()).cast(EVIDENCE), F.col("_remote"), mentions.cast(EVIDENCE)
        ),
        "_levels": levels.cast(EVIDENCE),
        "_denied": denied,
        "_durations": F.concat(*[_duration_evidence(_texts()[f], F.col(f"_judged_{f}")) for f in TEXT_FIELDS]),
    }


def _resolving_columns() -> dict[str, Column]:
    on_label = lambda e: e["field"] == "experienceLabel"
    accepted = F.coalesce(F.col("experience_required") == F.lit(False), F.lit(False)) | F.exists(
        "_levels", lambda e: e["rule_id"].isin(*ACCEPTANCE_RULES)
    )
    return {
        "_on_label": _months(F.col("_durations"), on_label),
        "_in_text": _months(F.col("_durations"), lambda e: ~on_label(e)),
        "_accepted": accepted,
        "_junior": F.exists("_levels", lambda e: e["kind"] == "junior_claim"),
    }


def _conflict_columns() -> dict[str, Column]:
    title, body = (_texts()[f] for f in TEXT_FIELDS[:2])
    junior, senior = F.col("_junior"), F.col("_senior")
    role_conflict = junior & F.col("_senior_role").isNotNull() & ~senior
    kind = F.when(junior, "conflict").otherwise("exclusion")
    rule = F.when(junior, "SENIOR_TITLE_JUNIOR_CONFLICT").otherwise("EXPLICIT_SENIOR_TITLE")
    clash = F.array_compact(
        F.array(
            F.when(senior, title.proof_of(kind, rule, F.col("_senior_title"))),
            F.when(role_conflict, body.proof_of("conflict", "SENIOR_ROLE_JUNIOR_CONFLICT", F.col("_senior_role"))),
        )
    )
    return {
        "evidence": F.concat("_first", "_levels", "_durations", clash.cast(EVIDENCE)),
        "_role_conflict": role_conflict,
        "minimum_experience_months": resolved_minimum(F.concat("_on_label", "_in_text"), F.col("_accepted")),
    }


def _warning_columns() -> dict[str, Column]:
    return {"warnings": _warnings()}


def classify(offers: DataFrame) -> DataFrame:
    """Status, tri-state answers, minimum months, remote mode, technologies, evidence in order and warnings."""
    kept = offers.columns
    df = level_matches(matching_forms(offers)).withColumns(_built("enriched", _enriched_columns))
    df = _judged_mentions(df).withColumns(_built("claims", _claim_columns))
    df = senior_wording(df.withColumns(_built("resolving", _resolving_columns)))
    df = df.withColumns(_built("conflicts", _conflict_columns)).withColumns(_built("warnings", _warning_columns))
    answers = computed_once(_resolved(df).select(*kept, *RESULT_COLUMNS), "_answers", F.struct(*RESULT_COLUMNS))
    return answers.select(*kept, *[F.col("_answers")[c].alias(c) for c in RESULT_COLUMNS])


RESULT_COLUMNS = (
    "status", "claims_junior", "minimum_experience_months", "beginner_friendly", "contradictory_junior", "salary_transparent",
    "remote_mode", "technology_slugs", "evidence", "rule_ids", "warnings",
)


def _senior_columns() -> dict[str, Column]:
    title, senior = _texts()["title"], F.col("_senior_title")
    rest = F.substring(title.marked, senior["start"] + F.length(senior["hit"]) + 1, F.lit(_ALL))
    head = F.substring(title.marked, F.lit(1), senior["start"])
    either = F.rlike(rest, F.lit(P.rx(P.JUNIOR_AFTER_SENIOR))) | F.rlike(head, F.lit(P.rx(P.JUNIOR_BEFORE_SENIOR)))
    return {"_senior": senior.isNotNull() & ~F.coalesce(either, F.lit(False))}


def senior_wording(df: DataFrame) -> DataFrame:
    """Add `_senior`: a senior title, unless the title offers the junior level as an alternative."""
    return df.withColumns(_built("senior", _senior_columns))


def duration_evidence(df: DataFrame, field: str) -> DataFrame:
    """Add `evidence`: what the durations of one text prove."""
    text = _texts()[field]
    df = _judged_mentions(df, (field,))
    return df.withColumn("evidence", _duration_evidence(text, F.col(f"_judged_{field}")))


def resolved_minimum(required: Column, accepted: Column) -> Column:
    """The largest required duration; an explicit acceptance of beginners counts as zero months."""
    return F.array_max(F.when(accepted, F.array_append(required, F.lit(0))).otherwise(required))


def conflict_codes(
    level_clash: Column, role_clash: Column, accepted: Column, not_required: Column, minimum: Column, on_label: Column, in_text: Column
) -> list[Column]:
    """Codes of the blocking conflicts in order, each null when it does not apply.

    `on_label` and `in_text` are the required durations of the structured label and of the texts.
    """
    above_zero = F.exists(F.concat(on_label, in_text), lambda m: m > 0)
    apart = (F.size(on_label) > 0) & (F.size(in_text) > 0) & ~F.arrays_overlap(on_label, in_text)
    return [
        F.when(level_clash, "CONFLICTING_JUNIOR_SIGNALS"),
        F.when(role_clash, "CONFLICTING_JUNIOR_SIGNALS"),
        F.when(accepted & (F.coalesce(minimum, F.lit(0)) > 0), "BEGINNER_EXPERIENCE_CONFLICT"),
        F.when(not_required & above_zero, "STRUCTURED_EXPERIENCE_CONFLICT"),
        F.when(apart, "STRUCTURED_DURATION_CONFLICT"),
    ]


def _warnings() -> Column:
    def entry(code: Column, severity: str) -> Column:
        return F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit(severity).alias("severity")))

    codes = conflict_codes(
        F.col("_junior") & (F.col("_senior") | F.col("_denied")),
        F.col("_role_conflict"),
        F.col("_accepted"),
        F.col("experience_required") == F.lit(False),
        F.col("minimum_experience_months"),
        F.col("_on_label"),
        F.col("_in_text"),
    )
    return F.array_compact(F.array(entry(remote_warning(F.col("_remote")), "warning"), *[entry(c, "blocking") for c in codes]))


def _status_columns() -> dict[str, Column]:
    claims = F.when(F.col("_senior") & ~F.col("_junior"), False).when(F.col("_junior"), True).when(F.col("_denied"), False)
    blocked = F.exists("warnings", lambda w: w["severity"] == "blocking")
    resolved = claims.isNotNull() | F.col("minimum_experience_months").isNotNull()
    return {
        "claims_junior": claims,
        "status": F.when(blocked, "ambiguous").when(resolved, "classified").otherwise("unclassified"),
        "remote_mode": remote_mode(F.col("_remote")),
        "technology_slugs": technology_slugs(F.col("_selected")),
        "rule_ids": F.array_distinct(F.transform("evidence", lambda e: e["rule_id"])),
    }


def _answer_columns() -> dict[str, Column]:
    minimum, claims = F.col("minimum_experience_months"), F.col("claims_junior")
    classified = F.col("status") == "classified"
    return {
        "beginner_friendly": F.when(classified, F.when(F.col("_accepted"), True).otherwise(minimum <= 12)),
        "contradictory_junior": F.when(classified & claims, minimum >= 24).when(classified & ~claims, False),
    }


def _resolved(df: DataFrame) -> DataFrame:
    return df.withColumns(_built("status", _status_columns)).withColumns(_built("answers", _answer_columns))


# ---------------------------------------------------------------- observation axis


def observation(
    claims_junior: Column, status: Column, junior_rules: Column, months: Column, blocking: Column
) -> tuple[Column, Column]:
    """(status, contradictory) of the separate axis from the resolved parts of a classification.

    `junior_rules` are the rule ids of the level claims, `months` the required durations, `blocking` the
    codes of the blocking warnings.
    """
    foreign = F.exists(blocking, lambda c: ~c.isin(*COHERENCE_CONFLICTS)) | ((status == "ambiguous") & (F.size(blocking) == 0))
    unclaimed = ~F.coalesce(claims_junior, F.lit(False)) | (F.size(junior_rules) == 0)
    straddling = (
        F.array_contains(blocking, "STRUCTURED_DURATION_CONFLICT")
        & F.exists(months, lambda m: m < 24)
        & F.exists(months, lambda m: m >= 24)
    )
    accepts = F.exists(junior_rules, lambda r: r.isin(*ACCEPTANCE_RULES))
    calm = F.size(blocking) == 0
    axis = (
        F.when(foreign, "ambiguous")
        .when(unclaimed, "unknown")
        .when(straddling, "ambiguous")
        .when(F.size(months) > 0, "resolved")
        .when(calm & accepts, "resolved")
        .when(calm, "unknown")
        .otherwise("ambiguous")
    )
    contradictory = F.when(axis == "resolved", F.exists(months, lambda m: m >= 24))
    return axis, contradictory


def with_observation(classified: DataFrame) -> DataFrame:
    evidence, warnings = F.col("evidence"), F.col("warnings")
    rules = F.transform(F.filter(evidence, lambda e: e["kind"] == "junior_claim"), lambda e: e["rule_id"])
    blocking = F.transform(F.filter(warnings, lambda w: w["severity"] == "blocking"), lambda w: w["code"])
    df = classified.withColumn("_rules", rules).withColumn("_blocking", blocking)
    df = df.withColumn("_asked", _months(evidence, lambda e: F.lit(True)))
    axis, contradictory = observation(F.col("claims_junior"), F.col("status"), F.col("_rules"), F.col("_asked"), F.col("_blocking"))
    df = df.withColumn("junior_observation_status", axis).withColumn("junior_observation_contradictory", contradictory)
    return df.withColumn("junior_observation_version", F.lit(OBSERVATION_VERSION)).drop("_rules", "_blocking", "_asked")


def result_hash() -> Column:
    """Hash over classification and observation, for the check that a stored result never changes."""
    columns = [*RESULT_COLUMNS, "junior_observation_status", "junior_observation_contradictory"]
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


# ---------------------------------------------------------------- bridge tables and backfill


def evidence_table(classified: DataFrame, key: str = "classification_id") -> DataFrame:
    """One row per proof with its ordinal."""
    rows = classified.select(key, F.posexplode_outer("evidence").alias("ordinal", "proof"))
    return rows.select(key, "ordinal", "proof.*").filter(F.col("ordinal").isNotNull())


def technology_mentions(evidence: DataFrame, key: str = "classification_id") -> DataFrame:
    """Bridge rows of technologies with the ordinal of their proof."""
    rows = evidence.filter(F.col("kind") == "technology")
    return rows.select(key, F.col("normalized_value").alias("slug"), "ordinal", F.lit(1).cast("decimal(5,4)").alias("confidence"))


def evidence_summary(evidence: DataFrame, key: str = "classification_id") -> DataFrame:
    required = F.col("kind") == "required_experience"
    months = F.collect_set(F.when(required, F.col("normalized_value").cast("int")))
    return evidence.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("kind") == "junior_claim").alias("junior_claim"),
        F.count_if(required).alias("required_experience"),
        F.count_if(F.col("rule_id").isin(*ACCEPTANCE_RULES)).alias("beginner_acceptance"),
        F.array_sort(months).alias("required_months"),
    )


def semantic_violations(classified: DataFrame, summary: DataFrame, key: str = "classification_id") -> DataFrame:
    """Codes of classifications whose answers do not follow from their evidence, one row per code."""
    df = classified.join(summary, key, "left").withColumn("required_months", F.coalesce("required_months", F.array().cast("array<int>")))
    count = lambda c: F.coalesce(c, F.lit(0))
    months, claims = F.col("minimum_experience_months"), F.col("claims_junior")
    status = F.col("status")
    answers = [F.col(c).isNotNull() for c in ("claims_junior", "minimum_experience_months", "beginner_friendly", "contradictory_junior")]
    expected_friendly = months <= 12
    expected_contradiction = F.when(claims, months >= 24).when(~claims, False)
    matching = F.array_contains("required_months", months) | ((months == 0) & (count("beginner_acceptance") > 0))
    codes = [
        F.when(F.size("evidence") != count("total"), "evidence_count_mismatch"),
        F.when(claims & (count("junior_claim") == 0), "junior_claim_without_evidence"),
        F.when(months.isNotNull() & ~F.coalesce(matching, F.lit(False)), "resolved_experience_without_matching_evidence"),
        F.when((status == "unclassified") & reduce(lambda a, b: a | b, answers), "unclassified_values_not_null"),
        F.when((status == "ambiguous") & (answers[2] | answers[3]), "ambiguous_derived_value_not_null"),
        F.when((status == "classified") & ~F.col("beginner_friendly").eqNullSafe(expected_friendly), "beginner_friendly_formula_mismatch"),
        F.when((status == "classified") & ~F.col("contradictory_junior").eqNullSafe(expected_contradiction), "contradiction_formula_mismatch"),
        F.when(
            F.col("contradictory_junior") & ((count("junior_claim") == 0) | (count("required_experience") == 0)),
            "contradiction_without_both_evidence_types",
        ),
    ]
    return df.select(key, F.explode(F.array_compact(F.array(*codes))).alias("code"))


def missing_classifications(snapshots: DataFrame, classifications: DataFrame, version: str) -> DataFrame:
    """Snapshots without a classification of this version."""
    done = classifications.filter(F.col("classifier_version") == version).select("snapshot_id")
    return snapshots.join(done, "snapshot_id", "left_anti")


def reclassify_backfill(snapshots: DataFrame, classifications: DataFrame, version: str = CLASSIFIER_VERSION) -> DataFrame:
    """Classifications of the snapshots that lack this version, ready to append."""
    missing = missing_classifications(snapshots, classifications, version)
    results = with_observation(classify(missing))
    return results.withColumn("classifier_version", F.lit(version)).withColumn("result_hash", result_hash())


def changed_results(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of the same snapshot and version whose hash differs; must be empty."""
    keys = ["snapshot_id", "classifier_version"]
    joined = stored.select(*keys, F.col("result_hash").alias("stored_hash")).join(fresh.select(*keys, "result_hash"), keys)
    return joined.filter(F.col("stored_hash") != F.col("result_hash"))
