"""Secret scans through a trigram inverted index, in DataFrame operations only.

From each rule's regex follows a Boolean query of trigrams that every match must contain. The index holds postings (trigram, doc_id) of
the trigrams that some rule asks for, over case-folded texts. Intersecting postings gives each rule's candidates, and only those are
searched by the regex; a rule without mandatory trigrams searches all texts. Spans count code points, the end is exclusive.

Defined results: a null or empty text has no findings; rows that share a doc_id share candidates and are verified each; rows
without a doc_id are outside the index and searched by all rules; other columns of the input are not read, or pass through
`redacted` as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as op, _parser

from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.shared import materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern whose group has at least `least` characters; fold: letters in either case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False

    @property
    def regex(self) -> str:
        return ("(?i)" if self.fold else "") + self.pattern


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # whole runs of 24 or more: the same as all runs, less the short ones
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
#: Sets of strings that a query may grow to before it is closed.
_MOST = 64
#: Items that running sums append to one array.
_BLOCK = 512

Query = list[frozenset[str]]


def mandatory(pattern: str) -> Query:
    """Sets of case-folded strings: a text that matches contains a string of each set. Strings have three characters or more."""
    out: Query = []

    def close(heads: set[str]) -> set[str]:
        if heads and min(map(len, heads)) >= 3:
            out.append(frozenset(h for h in heads if not any(o != h and o in h for o in heads)))
        return {""}

    def exact(node) -> set[str] | None:
        """All strings that the node matches, if they are few."""
        kind, of = node
        if kind is op.LITERAL:
            return {chr(of).lower()}
        if kind is op.IN and all(k is op.LITERAL for k, _ in of):
            return {chr(c).lower() for _, c in of}
        if kind is op.SUBPATTERN:
            return joined(of[3])
        if kind is op.BRANCH:
            parts = [joined(p) for p in of[1]]
            return None if None in parts else set().union(*parts)
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and of[1] == 1:
            inner = joined(of[2])
            return None if inner is None else inner | ({""} if of[0] == 0 else set())
        return None

    def joined(nodes) -> set[str] | None:
        parts = [exact(n) for n in nodes]
        return None if None in parts else {"".join(p) for p in product(*parts)}

    def walk(nodes, heads: set[str]) -> set[str]:
        for node in nodes:
            found = exact(node)
            if found is not None and len(found) * len(heads) <= _MOST:
                heads = {h + f for h in heads for f in found}
            elif node[0] is op.SUBPATTERN:
                heads = walk(node[1][3], heads)
            else:
                heads = close(heads)
        return heads

    close(walk(_parser.parse(pattern), {""}))
    return out


def trigrams(string: str) -> list[str]:
    return sorted({string[i : i + 3] for i in range(len(string) - 2)})


def _folded(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def postings(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The index, (trigram, doc_id), of the trigrams that the rules' queries ask for."""
    asked = sorted({t for r in rules for strings in mandatory(r.pattern) for s in strings for t in trigrams(s)})
    folded = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", _folded(F.col("text")).alias("folded"))
    held = F.array_compact(F.array(*(F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in asked)))
    return folded.select(F.explode(held).alias("trigram"), "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): the indexed rules whose Boolean query the document's postings satisfy."""
    of_doc = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))

    def holds(query: Query) -> Column:
        string = lambda s: reduce(Column.__and__, (F.array_contains("held", t) for t in trigrams(s)))
        return reduce(Column.__and__, (reduce(Column.__or__, map(string, sorted(strings))) for strings in query))

    kinds = F.array_compact(F.array(*(F.when(holds(q), F.lit(r.kind)) for r in rules if (q := mandatory(r.pattern)))))
    return of_doc.select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often and wherever use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(steps: Column, of: Callable[[Column, Column], Column]) -> Column:
    """Running results of `of`, as sums or maxima, over an array of numbers. An append copies its array, so blocks are run apart and then meet what lies before them: the work is linear up to millions of items."""
    after = lambda before, x: F.coalesce(of(before, x), x)
    last = lambda xs: F.get(xs, F.size(xs) - 1)
    run = lambda xs: F.aggregate(xs, F.array().cast("array<int>"), lambda done, x: F.concat(done, F.array(after(last(done), x))))
    blocks = lambda xs: F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(_BLOCK)), lambda at: run(F.slice(xs, at, F.lit(_BLOCK))))
    moved = lambda parts, ends: F.flatten(F.transform(parts, lambda part, i: F.transform(part, lambda x: after(F.get(ends, i - 1), x))))
    return _bound(steps, lambda xs: _bound(blocks(xs), lambda parts: _bound(run(F.transform(parts, last)), lambda ends: moved(parts, ends))))


def _found(rule: Rule, order: int) -> Column:
    """The rule's findings in `text`, leftmost first: (start, order, end) in code points, and the same in bytes (since, until). The texts between matches and the matches give the places."""
    match = F.regexp_extract_all("text", F.lit(rule.regex), F.lit(0))
    parts = [F.split("text", rule.regex, -1).alias("gap"), match.alias("match")]
    if rule.group:
        parts.append(F.regexp_extract_all("text", F.lit(rule.regex), F.lit(rule.group)).alias("kept"))
    long = lambda of, part: F.coalesce(of(part["match"]), F.lit(0))
    ends = lambda of, parts: _running(F.transform(parts, lambda p: of(p["gap"]) + long(of, p)), Column.__add__)

    def placed(parts: Column) -> Column:
        at = F.arrays_zip(parts.alias("part"), ends(F.length, parts).alias("end"), ends(F.octet_length, parts).alias("until"))
        good = F.filter(at, lambda x: F.length(x["part"]["kept" if rule.group else "match"]) >= rule.least)
        since = lambda x, end, of: x[end] - long(of, x["part"])
        return F.transform(good, lambda x: F.struct(since(x, "end", F.length).alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), since(x, "until", F.octet_length).alias("since"), x["until"].alias("until")))

    return F.when(F.regexp_like("text", F.lit(rule.regex)), _bound(F.arrays_zip(*parts), placed)).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<start:int,order:int,end:int,since:int,until:int>>")


def findings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs(doc_id, text, ...) with a column for each kind, its findings (start, order, end, since, until)."""
    index = materialize(postings(docs, rules), "postings")
    out = docs.join(candidates(index, rules).withColumnRenamed("doc_id", "_id").hint("merge"), F.col("doc_id") == F.col("_id"), "left")
    for order, rule in enumerate(rules):
        search = F.col("text").isNotNull()
        if mandatory(rule.pattern):
            search &= F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        out = out.withColumn(f"_{rule.kind}", F.when(search, _found(rule, order)).otherwise(_none()))
    return out.drop("_id", "kinds")


def _joined(rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    spans = F.array_sort(F.concat(*(F.col(f"_{r.kind}") for r in rules)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_<kind> of the base rules, base_sha256, spans) of every row: spans are kind:start:end by start, then in the rules' order."""
    found = findings(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules)
    counts = [F.size(f"_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(BASE), 256).alias("base_sha256"), _joined(rules).alias("spans"))


def _key_body(rest: Column) -> Column:
    """How many characters of rest, which follows a BEGIN mark, belong to its private key: through the END mark; where none comes before another BEGIN, the lines of base64 and of headers, or a run of base64."""
    stop, again = (F.position(F.lit(f"-----{mark} "), rest) for mark in ("END", "BEGIN"))
    mark = F.length(F.regexp_extract(F.substring(rest, stop, F.lit(60)), "^-----END [A-Z ]{0,30}PRIVATE KEY-----", 0))
    other = F.regexp_instr(rest, F.lit(r"(?m)^(?![ \t]*[A-Za-z0-9+/=]*[ \t\r]*$|[A-Za-z-]+: [\x20-\x7E]*\r?$)"))
    run = F.length(F.regexp_extract(rest, r"^\s*[A-Za-z0-9+/=]{16,}", 0))
    body = F.greatest(F.when(other > 0, other - 1).otherwise(F.length(rest)), run)
    return F.when((stop > 0) & ((again == 0) | (stop < again)) & (mark > 0), stop - 1 + mark).otherwise(body)


def _whole_keys(keys: Column, data: Column) -> Column:
    """Findings of BEGIN marks with their keys. What follows a mark is looked at through the next mark, so a text of many keys is read once."""

    def whole(key: Column, i: Column) -> Column:
        stop = F.coalesce(F.get(keys, i + 1)["until"], F.octet_length(data))
        rest = F.substring(data, key["until"] + 1, stop - key["until"]).cast("string")
        body = _bound(rest, lambda r: F.octet_length(F.substring(r, F.lit(1), _key_body(r))))
        return F.struct(key["start"], key["order"], key["end"], key["since"], (key["until"] + body).alias("until"))

    return F.transform(keys, whole)


def _without(data: Column, spans: Column, mark: str) -> Column:
    """The UTF-8 bytes as a text, with each run of overlapping spans (sorted) replaced by mark. Places are bytes, since a code point's place in a text is found by counting from its start."""

    def cut(ends: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        gap = lambda s, i: F.when(s["since"] >= before(i), F.substring(data, before(i) + 1, s["since"] - before(i)).cast("string"))
        tail = F.substring(data, before(F.size(ends)) + 1, F.octet_length(data)).cast("string")
        return F.array_join(F.concat(F.transform(spans, gap), F.array(tail)), mark)

    return _bound(_running(F.transform(spans, lambda s: s["until"]), F.greatest), cut)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with each finding's text replaced by mark, overlapping findings by one, and n_chars to match; other columns stay. A private key goes with its body, though its finding is the BEGIN mark."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    found = findings(docs.select(others.alias("row"), "doc_id", "text"), rules)

    def clean(data: Column) -> Column:
        kinds = (_bound(F.col(f"_{r.kind}"), lambda keys: _whole_keys(keys, data)) if r.kind == "private_key" else F.col(f"_{r.kind}") for r in rules)
        return _bound(F.array_sort(F.concat(*kinds)), lambda spans: _without(data, spans, mark))

    any_found = reduce(Column.__or__, (F.size(f"_{r.kind}") > 0 for r in rules))
    found = found.withColumn("clean", F.when(any_found, _bound(F.col("text").cast("binary"), clean)).otherwise(F.col("text")))
    columns = [F.col("clean").alias(c) if c == "text" else F.length("clean").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return found.select(*columns)
