"""Text expressions: tokens, prompt terms, detectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no signal in a prompt.
STOPWORDS = "the a an is are was were be do does did can could should would will what why how when where who which this that these those and or not for from with about into you your we our it its me my please help need want".split()
MAX_TERMS = 12
MIN_TERM = 3

# Phrases that state a cause.
CAUSAL_CUES = [
    "so that", "so", "because", "because of", "since", "as a result", "resulted in", "results in", "resulting in", "led to", "leads to", "leading to",
    "caused", "causes", "causing", "due to", "thanks to", "cause", "therefore", "thus", "hence", "consequently", "meant that", "means that", "in order to",
    "enabled", "enables", "enabling", "allowed", "allows", "made it possible", "blocked", "blocks", "blocking", "prevented", "prevents", "preventing",
    "stopped", "broke", "broken by", "triggered", "triggers", "forced", "forces", "why", "reason", "contradicts", "contradicted", "which is why",
]

# Shapes of text that reads like an instruction (case-insensitive).
INSTRUCTION_SHAPES = [
    r"\bignore\s+(?:all\s+|any\s+|the\s+|everything\s+)*(previous|prior|earlier|above|preceding)\b",
    r"\bdisregard\s+(?:all\s+|any\s+|the\s+|everything\s+)*(previous|prior|earlier|above|preceding)\b",
    r"\b(you\s+are\s+now|from\s+now\s+on\s+you)\b",
    r"\bnew\s+(system\s+)?(instructions?|rules?|directives?)\b",
    r"</?(system|assistant|user)>",
    r"(?m)^\s*(system|assistant)\s*:",
    r"\b(reveal|print|output|repeat)\b.{0,30}\b(system\s+prompt|instructions)\b",
    r"\boverride\b.{0,20}\b(instructions?|rules?|safety)\b",
]

# Secrets and contacts that must not leave; the flag says whether case matters.
SECRET_SHAPES = [
    ("email", r"[\w.+-]+@[\w-]+\.[\w.-]+", True),
    ("aws_key", r"\bAKIA[0-9A-Z]{16}\b", True),
    ("token", r"\b(sk|rzp|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{8,}", False),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", True),
    ("bearer", r"\b(?:Bearer|Authorization:)\s+[A-Za-z0-9._~+/=-]{12,}", False),
]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits without stopwords, in order, with repeats."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: (w != "") & ~w.isin(STOPWORDS))


def prompt_terms(text: Column, most: int = MAX_TERMS) -> Column:
    """The words of a prompt worth searching for: distinct, in order of first use."""
    raw = F.split(F.lower(text), r"[^\p{L}\p{N}_.\-/]+")
    bare = F.transform(raw, lambda w: F.regexp_replace(w, r"^[\-./]+|[\-./]+$", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda w: (F.length(w) >= MIN_TERM) & ~w.isin(STOPWORDS))), 1, most)


def any_of(text: Column, patterns: list[str], flags: str = "(?i)") -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(flags + p)
    return F.coalesce(found, F.lit(False))


def cue_pattern() -> str:
    """One alternation with the longest cue first."""
    return r"(?i)\b(?:" + "|".join(sorted(CAUSAL_CUES, key=lambda c: (-len(c), c))) + r")\b"


def states_a_cue(text: Column) -> Column:
    return F.coalesce(text.rlike(cue_pattern()), F.lit(False))


def instruction_like(text: Column) -> Column:
    return any_of(text, INSTRUCTION_SHAPES)


def secret_rule(text: Column) -> Column:
    """Name of the first secret shape in the text, or null."""
    rule = F.lit(None).cast("string")
    for name, shape, exact in reversed(SECRET_SHAPES):
        rule = F.when(text.rlike(shape if exact else "(?i)" + shape), name).otherwise(rule)
    return rule


def quotes_the_text(quote: Column, text: Column) -> Column:
    """The quote occurs in the text, white space and case aside."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.coalesce((F.length(flat(quote)) > 0) & F.contains(flat(text), flat(quote)), F.lit(False))


def scope_name(name: Column, most: int = 64) -> Column:
    """Name of a project or agent as a path segment: [A-Za-z0-9._-], at most 64 characters, 'unknown' if nothing is left."""
    clean = F.substring(F.regexp_replace(F.regexp_replace(F.trim(name), r"[^a-zA-Z0-9._-]+", "-"), r"^-+|-+$", ""), 1, most)
    return F.when(F.length(clean) > 0, clean).otherwise("unknown")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def human_part(prompt: Column, tags: tuple[str, ...] = ("system-reminder", "task-notification", "local-command-stdout", "command-name")) -> Column:
    """A prompt without the blocks that a harness put into it."""
    out = prompt
    for t in tags:
        out = F.regexp_replace(out, rf"(?s)<{t}>.*?</{t}>", "")
    return F.trim(out)


def estimate_tokens(chars: Column) -> Column:
    return F.floor(chars / 4).cast("bigint")


def embed_text(source: Column, target: Column, fact: Column) -> Column:
    """What is embedded for a fact."""
    return F.when(source.isNotNull() & target.isNotNull(), F.concat(source, F.lit(" "), target, F.lit(". "), fact)).otherwise(fact)
