"""Rule scores of candidate texts as Column expressions: null texts and blank ones have no score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tallyforge.functions.rules import Rules, searched

# Patterns that decide the scores, searched without regard to case.
CERTAIN = [
    r"\bconfirmed\b.{0,60}roles?\b",
    r"\bwe know\b.{0,60}(AI|ML|hiring)\b",
    r"\btheir team is\b.{0,60}(growing|expanding)\b",
    r"\byou.re (scaling|growing|expanding) aggressively\b",
    r"\byour hiring has (tripled|doubled|skyrocketed)\b",
]
HEDGES = [
    r"\bappears to\b",
    r"\bbased on (public )?signals?\b",
    r"\bour research suggests?\b",
    r"\bpotentially\b",
    r"\blikely\b",
    r"\bmay (be|have)\b",
    r"\bseems? to\b",
    r"\bwe (believe|understand|noticed)\b",
    r"\bpublic(ly available)? signal\b",
]
INTERROGATIVE = [
    r"\bis (hiring|your team|the queue|velocity)\b.{0,40}\?",
    r"\bif (you.re|you are|the|your)\b.{0,60}(scoping|considering|looking|hiring|open)\b",
    r"\bi cannot tell from the outside\b",
    r"\bcurious (whether|if|how)\b",
    r"\bwould (a|it|this)\b.{0,40}\?",
    r"\bare you (open|scoping|considering|looking)\b",
    r"\bcheck if you (are|would)\b",
    r"\bwanted to (check|ask|see if)\b",
    r"\bopen to (discussing|exploring|a)\b",
]
STOP_WORDS = ["with", "when", "that", "from", "this"]
ESCALATION = [
    r"\bcheck with our delivery lead\b",
    r"\bconfirm (availability|capacity)\b",
    r"\bconfirm engineering team availability\b",
    r"\bsubject to (delivery lead )?confirmation\b",
    r"\blet me (verify|confirm|check)\b",
    r"\bI.{0,10}ll (confirm|verify|check|revert)\b",
    r"\bI will (verify|confirm|check|revert)\b",
    r"\bpending confirmation\b",
    r"\bloop in our delivery lead\b",
    r"\bescalate to\b",
    r"\bdelivery lead (confirmation|to confirm|to lock)\b",
]
HARD_COMMIT = r"\b(can|will)\s+(place|provide|supply|deliver|staff)\s+\d+\s+(engineer|developer|ml|data)"
SPECIALIST = [
    "mlops", "ml", "machine learning", "ai", "data", "platform",
    "devops", "sre", "security", "mobile", "ios", "android",
    "frontend", "front-end", "backend", "back-end", "fullstack",
    "full-stack", "go", "python", "java", "rust", "infra",
    "infrastructure", "cloud", "research", "scientist",
]
BANNED = [
    "world-class", "top talent", "A-players", "rockstar", "ninja", "wizard", "skyrocket", "supercharge", "10x",
    "I hope this email finds you well", "just following up", "circling back", "Quick question", "Quick chat",
    "synergize", "synergy", "leverage", "ecosystem", "game-changer", "disruptor", "paradigm shift",
    "our proprietary", "our AI-powered", "You'll regret missing this", "Don't miss out", "Per my last email",
    "our 500 employees", "our 20 years of experience", "I'll keep this brief", "I noticed you're a",
]
BANNED_WORD = r"\bbench\b"
CONDESCENDING = [
    r"\bas I (mentioned|said|noted)\b",
    r"\byou.{0,5}(need to|should|must) understand\b",
    r"\bobviously\b",
    r"\bclearly you\b",
    r"\blet me (be|make it) clear\b",
    r"\byou.re (falling|behind|losing)\b",
    r"\byour (AI maturity|team|strategy) is behind\b",
]
FILLERS = r"\b(just|basically|essentially|actually|literally)\b"
SUPERLATIVES = r"\b(best|unparalleled|top-notch|amazing|excellent engineers)\b"
HONEST = [
    r"\bhowever\b",
    r"\bthat said\b",
    r"\bone consideration\b",
    r"\blimitation\b",
    r"\bif (you.re|you are|the)\b",
    r"\bsubject to\b",
    r"\bpending\b",
    r"\bcannot (confirm|commit|guarantee)\b",
]
SHOUTING = r"[A-Z]{5,}"
#: Highest score of each dimension.
HIGHEST = {"signal_grounding": 3, "capacity_honesty": 3, "tone_preservation": 5, "consent_coordination": 3, "gap_framing": 3}

#: The sections that settings name, with the values above.
RULES = Rules({
    "hedge_patterns": tuple(HEDGES), "interrogative_patterns": tuple(INTERROGATIVE), "escalation_patterns": tuple(ESCALATION),
    "banned_phrases": tuple(BANNED), "bench_external_ban": ("bench",), "condescending_patterns": tuple(CONDESCENDING), "honest_patterns": tuple(HONEST),
})


def any_of(text: Column, patterns: list[str]) -> Column:
    return reduce(Column.__or__, [text.rlike(searched(p)) for p in patterns])


def _point(condition: Column, points: int = 1) -> Column:
    return F.when(condition, points).otherwise(0)


def scored(text: Column, score: Column) -> Column:
    """``score`` where ``text`` has anything but white space."""
    return F.when(text.rlike(searched(r"\S")), score)


def keywords(behaviour: Column) -> Column:
    """The first three words of four or more characters that aren't stop words, in lower case."""
    words = F.transform(F.regexp_extract_all(behaviour, F.lit(r"(?U)(\w{4,})"), 1), lambda w: F.lower(w))
    return F.slice(F.filter(words, lambda w: ~w.isin(STOP_WORDS)), 1, 3)


def signal_score(text: Column, behaviours: Column, rules: Rules = RULES) -> Column:
    """0 to 3 from hedges, questions and the first of the expected ``behaviours`` (an array of strings)."""
    low = F.lower(text)
    met = F.coalesce(F.exists(keywords(F.get(behaviours, 0)), lambda k: F.contains(low, k)), F.lit(False))
    points = _point(rules.any_of(text, "hedge_patterns")) + _point(rules.any_of(text, "interrogative_patterns")) + _point(met)
    return scored(text, F.when(any_of(text, CERTAIN), 0).otherwise(points))


def signal_trouble(text: Column, rules: Rules = RULES) -> Column:
    """The broken pattern that a signal score meets, else null: all hedges are tried, questions until one is found."""
    met = F.coalesce(rules.trouble(text, "hedge_patterns", True), rules.trouble(text, "interrogative_patterns"))
    return F.when(~any_of(text, CERTAIN), met)


def _stacks(text: Column, role: Column, behaviours: Column, roles: Column) -> tuple[Column, Column]:
    """Names of the relevant stacks, and whether the text commits to people that there aren't."""
    hint = F.lower(F.concat(F.coalesce(role, F.lit("")), F.lit(" "), F.coalesce(F.array_join(behaviours, " "), F.lit(""))))
    special = reduce(Column.__or__, [F.contains(hint, F.lit(k)) for k in SPECIALIST])
    roles = F.coalesce(roles, F.array().cast("array<struct<stack:string,count:bigint>>"))
    names = F.filter(F.transform(roles, lambda r: F.lower(r["stack"])), lambda n: F.coalesce(n, F.lit("")) != "")
    relevant = F.filter(names, lambda n: F.contains(hint, n) | ~special)
    total = F.aggregate(roles, F.lit(0).cast("bigint"), lambda a, r: a + F.coalesce(r["count"], F.lit(0)))
    return relevant, text.rlike(searched(HARD_COMMIT)) & ((total == 0) | (F.size(relevant) == 0))


def capacity_score(text: Column, role: Column, behaviours: Column, roles: Column, rules: Rules = RULES) -> Column:
    """0 to 3. ``roles`` is an array of (stack, count); null and empty stacks are no names."""
    relevant, commits = _stacks(text, role, behaviours, roles)
    named = F.exists(relevant, lambda n: F.contains(F.lower(text), n))
    return scored(text, F.when(commits, 0).otherwise(_point(rules.any_of(text, "escalation_patterns"), 2) + _point(named)))


def capacity_trouble(text: Column, role: Column, behaviours: Column, roles: Column, rules: Rules = RULES) -> Column:
    return F.when(~_stacks(text, role, behaviours, roles)[1], rules.trouble(text, "escalation_patterns"))


def tone_banned(text: Column, rules: Rules = RULES) -> Column:
    return rules.phrase(text, "banned_phrases") | rules.word(text, "bench_external_ban")


def tone_blocked(text: Column, rules: Rules = RULES) -> Column:
    """Whether a hard gate of the tone holds: a banned phrase or word, or a condescending pattern."""
    return tone_banned(text, rules) | rules.any_of(text, "condescending_patterns")


def tone_trouble(text: Column, rules: Rules = RULES) -> Column:
    """The broken pattern that a tone score meets; caveats are only looked for where no gate holds."""
    soft = F.when(~tone_blocked(text, rules), rules.trouble(text, "honest_patterns"))
    return F.coalesce(F.when(~tone_banned(text, rules), rules.trouble(text, "condescending_patterns")), soft)


def tone_soft(text: Column, rules: Rules = RULES) -> Column:
    """1 to 5: few fillers, no superlative, a caveat, no run of capitals, and one point for all."""
    words = F.greatest(F.size(F.filter(F.split(text, searched(r"\s+")), lambda w: w != "")), F.lit(1))
    few = F.regexp_count(text, F.lit(searched(FILLERS))) / words < 0.03
    return _point(few) + _point(~any_of(text, [SUPERLATIVES])) + _point(rules.any_of(text, "honest_patterns")) + _point(~text.rlike(SHOUTING)) + 1


def tone_score(text: Column, judged: Column | None = None, rules: Rules = RULES) -> Column:
    """0 to 5. A score ``judged`` elsewhere takes the place of the soft rules where it isn't null."""
    soft = tone_soft(text, rules) if judged is None else F.coalesce(judged.cast("int"), tone_soft(text, rules))
    return scored(text, F.when(tone_blocked(text, rules), 0).otherwise(soft))


def task_error(dimension: Column, text: Column, known: tuple[str, ...] = tuple(HIGHEST)) -> Column:
    """Why a task has no score; null where it has one."""
    return (
        F.when(F.coalesce(dimension, F.lit("")) == "", "missing_dimension")
        .when(~dimension.isin(*known), F.concat(F.lit("unknown_dimension: "), dimension))
        .when(~F.coalesce(text.rlike(searched(r"\S")), F.lit(False)), "empty_candidate")
    )


def normal_tail(z: Column) -> Column:
    """P(Z > z) by a polynomial whose error is under 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / F.lit(2.5066282746310002) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)

