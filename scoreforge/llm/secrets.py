"""Secret scans (operator 9), DataFrame functions only: a trigram inverted index chooses what each rule must scan.

From each rule's regular expression ``trigrams.derive`` makes a Boolean query on trigrams (in lower case, so that it holds for
either case). The index lists, for each trigram that any query has, the rows that contain it, as postings (trigram, row); it is
written, and its lists are counted. A query is answered by intersecting postings, the shortest lists first: they name the
rows of which the other lists are read; a row is a candidate if each clause has an alternative that is wholly there.
Candidates are verified by the expression itself, where the texts lie: few candidates are broadcast to them.
Rules whose expression has no mandatory trigram scan every text.

Spans are code points [start, end) of leftmost non-overlapping matches by kind. They are found without leaving the JVM:
``regexp_replace`` sets marks around each match and the lengths between marks are run up.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, checkpointed, together
from .trigrams import Query, derive

# Marks around matches: three noncharacters, which no rule matches; texts that hold them get another character there.
OPEN, MID, SHUT = "﷐", "﷑", "﷒"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern``, whose group ``keep`` must have ``least`` characters. A match goes on through ``rest``, which
    may be empty; the SQL for DuckDB knows only ``pattern``."""

    kind: str
    pattern: str
    keep: int
    least: int
    base: bool = False
    rest: str = ""

    def query(self) -> Query:
        """The Boolean trigram query. Empty: no mandatory trigrams, scan fully."""
        return derive(self.pattern)


#: Candidates (some 40 bytes each) are broadcast up to so many; beyond it they and the texts are shuffled.
BROADCAST_ROWS = 1_000_000

# A private key after its first line: up to the END line if that is the next line of dashes, else (a key cut short) the header
# fields and the lines of 16 characters of base64 or more, with a last shorter one.
_GAP = "(?:[ \\t\\r\\n]|\\\\[rnt])"
KEY_BODY = (
    "(?:(?>[\\s\\S]*?-----)END [A-Z ]{0,30}PRIVATE KEY-----"
    f"|(?:{_GAP}*+(?:Proc-Type|DEK-Info): [^\\r\\n\\\\]*+)*+(?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}})++"
    "(?:(?:\\r?\\n|\\\\n)[A-Za-z0-9+/]++={0,2}(?![^\\r\\n\\\\\"']))?|)"
)

# The rules. The first three are the base kinds; the order here breaks ties between kinds.
RULES = (
    Rule("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", "[0-9a-f]{16,}", 0, 16, True),
    Rule("private_key", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1, rest=KEY_BODY),
    Rule("web_token", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("prefixed", "(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 1),
)


def _spans(text: Column, rule: Rule, no: int) -> Column:
    """array<struct<start, no, end>> of the rule's matches in a text without marks."""
    marked = F.regexp_replace(text, F.lit(rule.pattern + rule.rest), F.lit(f"{OPEN}$0{MID}${rule.keep}{SHUT}"))
    pieces = F.split(marked, OPEN)
    step = lambda acc, piece: F.struct(
        (acc["at"] + F.length(F.substring_index(piece, MID, 1)) + F.length(F.substring_index(piece, SHUT, -1))).alias("at"),
        F.when(
            F.length(F.substring_index(F.substring_index(piece, SHUT, 1), MID, -1)) >= rule.least,
            F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), F.lit(no).alias("no"), (acc["at"] + F.length(F.substring_index(piece, MID, 1))).alias("end")))),
        ).otherwise(acc["found"]).alias("found"),
    )
    zero = F.struct(F.length(pieces[0]).alias("at"), F.array().cast("array<struct<start:int,no:int,end:int>>").alias("found"))
    found = F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), zero, step, lambda acc: acc["found"])
    return F.when(F.contains(marked, F.lit(OPEN)), found).otherwise(F.array().cast("array<struct<start:int,no:int,end:int>>"))


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index of the trigrams that the rules' queries have: postings (trigram, doc_id, key), key a hash of the text."""
    wanted = sorted({g for r in rules for clause in r.query() for alternative in clause for g in alternative})
    low = docs.select("doc_id", F.xxhash64("text").alias("key"), F.lower("text").alias("_low"))
    there = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in wanted])) if wanted else F.array().cast("array<string>")
    return low.select("doc_id", "key", F.explode(there).alias("trigram"))


def shortest(rules: tuple[Rule, ...], sizes: dict[str, int]) -> set[str]:
    """The trigrams whose postings have to be read first: of each rule's clauses the one that the fewest rows can satisfy, of each of its
    alternatives the trigram of the shortest list. An alternative with a trigram of no postings is met by no row."""
    first = set()
    for rule in rules:
        ways = []
        for clause in rule.query():
            least = [min(alternative, key=lambda g: (sizes.get(g, 0), g)) for alternative in clause]
            ways.append([g for g in least if sizes.get(g, 0)])
        first.update(min(ways, key=lambda gs: sum(sizes[g] for g in set(gs)), default=[]))
    return first


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, key, rules): the numbers of the rules whose query the postings of a row answer. Postings are intersected from the
    shortest lists on: only rows that these name are looked up in the others."""
    sizes = {r["trigram"]: r["n"] for r in postings.groupBy("trigram").agg(F.count(F.lit(1)).alias("n")).collect()}  # the queries' trigrams
    first = shortest(rules, sizes)
    rows = postings.where(F.col("trigram").isin(*sorted(first)) if first else F.lit(False)).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    few = sum(sizes[g] for g in first) <= broadcast_rows
    met = postings.join(F.broadcast(rows) if few else rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_semi")
    have = met.groupBy("doc_id", "key").agg(F.collect_set("trigram").alias("_have"))  # of a row: at most the queries' trigrams
    answers = []
    for no, rule in enumerate(rules):
        if rule.query():
            hit = F.lit(True)
            for clause in rule.query():
                ways = F.lit(False)
                for alternative in sorted(map(sorted, clause)):
                    ways = ways | (F.size(F.array_except(F.array(*[F.lit(g) for g in alternative]), F.col("_have"))) == 0)
                hit = hit & ways
            answers.append(F.when(hit, F.lit(no)))
    return have.select("doc_id", "key", F.filter(F.array(*answers) if answers else F.array().cast("array<int>"), lambda r: r.isNotNull()).alias("rules")).where(F.size("rules") > 0)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """All columns of ``docs`` (doc_id, text and any others) and ``_spans``: array<struct<start, no, end>> by start, then rule.

    Null and empty texts have no spans; rows with one doc_id are told apart by a hash of their texts, repeated rows share their
    candidates; null ids are scanned as well. An empty table gives no rows.
    """
    own = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text"))
    found = candidates(checkpointed(index(own.where("text is not null"), rules)), rules, broadcast_rows)
    found = checkpointed(found.select(F.col("doc_id").alias("_cand_id"), F.col("key").alias("_cand_key"), F.col("rules").alias("_rules")))
    few = found.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = docs.withColumn("_key", F.xxhash64(F.col("`text`")))
    rows = rows.join(F.broadcast(found) if few else found, rows["`doc_id`"].eqNullSafe(found["_cand_id"]) & (rows["_key"] == found["_cand_key"]), "left").drop("_cand_id", "_cand_key", "_key")
    clean = F.translate(F.coalesce(F.col("`text`"), F.lit("")), OPEN + MID + SHUT, "\ufffd" * 3)
    none = F.array().cast("array<struct<start:int,no:int,end:int>>")
    parts = []
    for no, rule in enumerate(rules):
        spans = _spans(clean, rule, no)
        parts.append(F.when(F.array_contains("_rules", no), spans).otherwise(none) if rule.query() else spans)
    return rows.withColumn("_spans", F.array_sort(F.concat(*parts))).drop("_rules")


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["no"] + 1), s["start"], s["end"])), ",")


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for each row.

    Null and empty texts have no spans (the hash is then that of an empty string); null and repeated ids and repeated rows give
    a row each; matches of several kinds at one place are all there, by the order of the rules. Either case means A-Z and a-z: the
    long s or the Kelvin sign stand for no letter of a rule. Further columns are ignored; an empty table gives no rows.
    """
    base = [no for no, r in enumerate(rules) if r.base]
    rows = scan(docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text")), rules)
    count = lambda no: F.size(F.filter("_spans", lambda s: s["no"] == no)).cast("long")
    return rows.select(
        "doc_id", *[count(no).alias(f"n_{rules[no].kind}") for no in base],
        F.sha2(_joined(F.filter("_spans", lambda s: s["no"].isin(base)), rules).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("_spans"), rules).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sign: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``sign`` (overlapping spans by one) and n_chars, if there, counted anew.

    Null texts stay null, texts without spans and their n_chars as they are; every row stays, repeated and null ids too, and
    so do further columns, whatever their names. An empty table gives no rows.
    """
    plain, names = apart(docs)
    rows = scan(plain, rules)
    text = F.col("`text`")
    step = lambda acc, s: F.struct(
        F.when(
            s["end"] <= acc["at"], acc["out"]
        ).when(
            s["start"] < acc["at"], acc["out"]
        ).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(sign))).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    made = F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(text.isNull() | (F.size("_spans") == 0), text).otherwise(made)
    if "n_chars" in names:
        at = f"c{names.index('n_chars')}"
        rows = rows.withColumn(at, F.when(F.size("_spans") == 0, F.col(at)).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType)))
    return together(rows.withColumn("text", new), names)


def brute(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """The same spans (start, rule, end) by Python's own engine: for tests. Letters in either case are those of ASCII, as Spark has it."""
    out = []
    for no, r in enumerate(rules):
        for m in re.finditer(r.pattern + r.rest, text or "", re.ASCII):
            if len(m[r.keep]) >= r.least:
                out.append((m.start(), no, m.end()))
    return sorted(out)
