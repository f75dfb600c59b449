"""Secret scans by a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams
(:mod:`cellweave.llm.trigrams`). The index is a stored table with a folder for each trigram
that any query names, which holds its posting list: the doc_ids whose lower-cased text has it. An alternative
of a rule's query looks up the lists of its trigrams, and no others are read; its candidates are the documents that
stand in all of them. The expression itself is tried on the whole text of the rule's candidates alone. A rule without
mandatory trigrams is tried on all texts.

Spans are in code points, end exclusive, leftmost and non-overlapping for each rule, and
matches with too short a value are dropped after that. Where a match begins is the
sum of the lengths of what a split by the expression leaves before it and of earlier matches.

Null text is empty. Rows that share a doc_id share its postings, and each is tried by
itself; so are rows without doc_id. No rows give none. Other columns may have any names; they are carried in one
structure and come back as they were. The work is DataFrame expressions alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm._shared import shuffle_width, stored, work_dir
from cellweave.llm.trigrams import ANY, query_of


@dataclass(frozen=True)
class Rule:
    """``value_group``'s text must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    value_group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # the runs of [0-9a-f]+ that have 32 characters
)
MORE = (
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._%+-]{1,64}:[A-Za-z0-9._%+-]{3,64}@"),
)
#: A private key goes up to its END line; without one, as far as lines of base64 (the last one may be short) go.
_KEY_BEGIN = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
_KEY_HEADERS = r"(?:[ \t\r\n]*[A-Za-z]+(?:-[A-Za-z]+)*:[^\n]*\n)*"
_KEY_LINES = r"(?:[ \t\r\n]+[A-Za-z0-9+/]{16,}={0,2})*(?:[ \t\r]*\n[A-Za-z0-9+/]{1,15}={0,2}(?![^\r\n]))?"
#: What :func:`redacted` takes out: MORE with whole keys and logins of any length. The SQL of the report is made from MORE, which stays.
WHOLE = tuple(
    {
        "private_key": Rule("private_key", _KEY_BEGIN + rf"(?:{_KEY_HEADERS}[^-]*-----END [A-Z ]{{0,30}}PRIVATE KEY-----|{_KEY_HEADERS}{_KEY_LINES})"),
        "url_login": Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+-]{3,}@"),
    }.get(r.kind, r)
    for r in MORE
)
#: Candidates (16 bytes each) up to which they are sent to all executors; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


class TrigramIndex:
    """The postings of all trigrams that the rules' queries name."""

    def __init__(self, rules: tuple[Rule, ...], folder: str):
        self.rules, self.folder = rules, folder
        self.queries = [query_of(r.pattern) for r in rules]
        self.grams = sorted({g for q in self.queries for option in q for g in option})

    def build(self, docs: DataFrame) -> None:
        """(doc_id, gram) for each trigram of a text that a query names, a folder per gram; ``docs``: doc_id and text."""
        low = docs.select("doc_id", F.lower("text").alias("low"))
        there = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(self.grams))))
        rows = low.select("doc_id", F.explode(there).alias("gram"))
        # a list is dealt to an eighth of the tasks, so that none writes all of a long one and a folder has few files
        few = F.pmod(F.xxhash64("doc_id"), F.lit(max(4, shuffle_width(docs.sparkSession) // 8)))
        self.postings = stored(rows.repartition("gram", few), f"{self.folder}/postings", "gram")

    def posting_lists(self, grams: list[str]) -> DataFrame:
        """(doc_id, gram) of these trigrams; the folders of others are not read."""
        return self.postings.where(F.col("gram").isin([self.grams.index(g) for g in grams])).distinct()

    def candidates(self) -> DataFrame:
        """(doc_id, rules): bit i for each rule i whose query the document satisfies."""
        options = [(i, n, option) for i, query in enumerate(self.queries) for n, option in enumerate(query)]
        needs = [(self.grams.index(g), i, n, len(option)) for i, n, option in options for g in option]
        wanted = self.postings.sparkSession.createDataFrame(needs, "gram int, rule int, option int, size int")  # a row per trigram of a query
        lists = self.posting_lists(sorted({g for _, _, option in options for g in option}))
        # the intersection of an alternative's lists: documents that stand in as many as there are
        held = lists.join(F.broadcast(wanted), "gram").groupBy("doc_id", "rule", "option", "size").agg(F.count("*").alias("n")).where("n = size")
        return held.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def _running(values: Column, block: int = 64) -> Column:
    """Sums up to and with each element, in blocks, so long arrays cost little more than their length."""
    zeros = F.array().cast("array<int>")
    upto = lambda xs: F.aggregate(xs, zeros, lambda a, x: F.concat(a, F.array((F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x).cast("int"))))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, block))
    with_blocks = lambda bs: F.flatten(
        F.zip_with(bs, upto(F.transform(bs, total)), lambda b, end: F.transform(upto(b), lambda x: x + end - total(b)))
    )
    return F.when(F.size(values) == 0, zeros).otherwise(F.get(F.transform(F.array(blocks), with_blocks), F.lit(0)))


def _lengths(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.length(x))


def _spans(number: int, rule: Rule, text: Column) -> Column:
    """array<struct<start, kind, end>> of one rule."""
    pattern = F.lit(rule.pattern)
    matches = _lengths(F.regexp_extract_all(text, pattern, F.lit(0)))
    values = _lengths(F.regexp_extract_all(text, pattern, F.lit(rule.value_group))) if rule.value_group else matches
    between = _lengths(F.split(text, rule.pattern, -1))

    def placed(x: Column) -> Column:
        ends = _running(F.zip_with(F.slice(x["between"], 1, F.size(x["matches"])), x["matches"], lambda a, b: a + b))
        whole = F.zip_with(ends, x["matches"], lambda end, n: F.struct((end - n).alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.filter(whole, lambda s, i: F.get(x["values"], i) >= rule.least)

    return F.get(F.transform(F.array(F.struct(matches.alias("matches"), values.alias("values"), between.alias("between"))), placed), F.lit(0))


def _scanned(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, text, secrets): the whole row of ``docs`` as a structure, its text not null, its spans."""
    spark = docs.sparkSession
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    folder = work_dir(spark, "secrets")
    index = TrigramIndex(rules, folder)
    index.build(held.select("doc_id", "text"))
    found = stored(index.candidates(), f"{folder}/candidates").select(F.col("doc_id").alias("id"), "rules")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    joined = held.join(found, held["doc_id"].eqNullSafe(found["id"]), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    hits = []
    for i, (rule, query) in enumerate(zip(rules, index.queries, strict=True)):
        tried = F.col("text").rlike(rule.pattern)
        if query != ANY:
            tried = (F.coalesce("rules", F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0) & tried
        hits.append(F.when(tried, _spans(i, rule, F.col("text"))).otherwise(none))
    return joined.select("row", "text", F.sort_array(F.concat(*hits)).alias("secrets"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id, text (not null) and ``secrets``: array<struct<start, kind, end>>, ordered; kind is the rule's place in ``rules``."""
    return _scanned(docs, rules).select("row.doc_id", "text", "secrets")


def told(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans, and all spans."""
    rules = BASE + MORE
    found = scan(docs.select("doc_id", "text"), rules).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] < len(BASE))
    counts = []
    for n, rule in enumerate(BASE):
        counts.append(F.size(F.filter("secrets", _of(n))).cast("bigint").alias(f"n_{rule.kind}"))
    return found.select("doc_id", *counts, F.sha2(told(base, rules), 256).alias("base_sha256"), told(F.col("secrets"), rules).alias("spans"))


def _of(kind: int):
    return lambda s: s["kind"] == kind


def redacted(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = BASE + WHOLE) -> DataFrame:
    """``docs`` with each stretch of text under any span replaced by ``mark``."""
    found = _scanned(docs, rules)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        kept = F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"])
        parts = F.when(s["start"] >= a["at"], F.concat(a["parts"], F.array(kept, F.lit(mark)))).otherwise(a["parts"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), parts.alias("parts"))

    rest = lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text")))
    text = F.when(F.size("secrets") == 0, F.col("text")).otherwise(F.aggregate("secrets", start, step, rest))
    return found.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
