r"""Operator 1, secret scans: a trigram inverted index in front of the rules.

Each rule's regex is turned into a Boolean trigram query: a choice of literal stretches, each of
which needs all its trigrams. The index holds postings (trigram, row) for the trigrams that any
rule asks for; postings of a choice are intersected by summing their bits per row, and the rows
left are verified with the regex itself. A rule without mandatory trigrams (hex) scans every text.

Everything is DataFrame functions. Postings are narrow rows, combined on the map side before the
only wide step: the join of candidates with texts, on a hash of (doc_id, text), which deals hot
sources, hot groups of copies (their ids differ) and null ids evenly.

Edge cases: a null text counts as empty; overlapping spans of different kinds all stay; equal rows
get equal results; rows with null doc_id are scanned; extra columns are carried along by ``scan``
(generated columns start with ``_s_``); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre  # the parse tree of Python's own regex parser
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import row_key, table

#: A class or choice with more ways than this ends a literal stretch.
MAX_WAYS = 8


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1


#: The three base rules in the order in which they are listed, then the added ones.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("login_url", r"[a-z]+://[^/\x20\x09-\x0D:@]+:[^/\x20\x09-\x0D:@]+@", 0, 8),
)
BASE_KINDS = 3


def literal_choices(pattern: str) -> list[list[str]]:
    """Alternatives of the regex, each a list of lower-case literals that it cannot match without."""
    done, open_ = _walk(list(sre_parser.parse(pattern)), [([], "")])
    return [[*words, tail] for words, tail in done + open_]


def _walk(items: list, states: list) -> tuple[list, list]:
    """states: (finished literals, the literal being built) of each alternative so far."""
    for op, arg in items:
        if op is sre.LITERAL:
            states = [(w, t + chr(arg).lower()) for w, t in states]
        elif op is sre.SUBPATTERN:
            _, states = _walk(list(arg[3]), states)
        elif op is sre.BRANCH:
            states = [s for part in arg[1] for s in _walk(list(part), states)[1]]
        elif op is sre.IN and (letters := _letters(arg)) and len(letters) <= MAX_WAYS:
            states = [(w, t + c) for w, t in states for c in letters]
        elif op is sre.MAX_REPEAT and arg[0] == 0 and arg[1] == 1 and len(arg[2]) == 1:
            states = states + _walk(list(arg[2]), states)[1]
        elif op is sre.MAX_REPEAT and arg[0] >= 1 and list(arg[2])[0][0] is sre.LITERAL:
            states = [([*w, x], x) for w, t in _walk(list(arg[2]) * min(arg[0], 8), states)[1] for x in [t]]
        else:  # anything else ends the stretch
            states = [([*w, t], "") for w, t in states]
        if len(states) > 64:  # too many ways: what was certain before them is enough
            states = [([*w, t], "") for w, t in states]
    return [], states


def _letters(members: list) -> list[str]:
    out: list[str] = []
    for op, arg in members:
        if op is sre.LITERAL:
            out.append(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < MAX_WAYS:
            out += [chr(c).lower() for c in range(arg[0], arg[1] + 1)]
        else:
            return []
    return sorted(set(out))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The regex as a choice of trigram sets, or None if some way through it needs no trigram."""
    sets = {frozenset(word[i : i + 3] for word in words for i in range(len(word) - 2)) for words in literal_choices(pattern)}
    if frozenset() in sets:
        return None
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def queries(rules: tuple[Rule, ...]) -> dict[int, list[frozenset[str]]]:
    """Rule number -> trigram query, for rules that have one."""
    found = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    return {n: q for n, q in found.items() if q is not None}


def postings(docs: DataFrame, trigrams: list[str], text: str, key: str) -> DataFrame:
    """The inverted index as rows (trigram, key), for the listed trigrams; letters in lower case."""
    return docs.select(F.col(key), F.lower(F.col(text)).alias("_s_low")).select(
        F.explode(F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("_s_low"), t))).alias("trigram"), F.col(key)
    )


def candidates(docs: DataFrame, rules: tuple[Rule, ...], text: str, key: str) -> DataFrame:
    """(key, _s_rules): the rules, as bits, whose trigram query a row satisfies."""
    spark, asked = docs.sparkSession, queries(rules)
    clauses = [(n, k, t, 1 << i) for n, q in asked.items() for k, s in enumerate(q) for i, t in enumerate(sorted(s))]
    need = [(n, k, (1 << len(s)) - 1) for n, q in asked.items() for k, s in enumerate(q)]
    wanted = F.broadcast(spark.createDataFrame(clauses, "rule int, clause int, trigram string, bit bigint"))  # as many rows as the rules have trigrams
    full = F.broadcast(spark.createDataFrame(need, "rule int, clause int, full bigint"))
    index = postings(docs, sorted({c[2] for c in clauses}), text, key)
    met = index.join(wanted, "trigram").groupBy(key, "rule", "clause").agg(F.bit_or("bit").alias("bits")).join(full, ["rule", "clause"]).where("bits = full")
    return met.groupBy(key).agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("_s_rules"))


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans of a rule as array<struct<start, kind, end>>: leftmost, non-overlapping, in code points.

    Offsets come from the lengths of the matches and of what lies between them.
    """
    pattern = F.lit(rule.pattern)
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    bound = F.array(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"), value.alias("value"), F.split(text, rule.pattern, -1).alias("gaps")))
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")

    def one(x: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.char_length(F.get(x["gaps"], i)).cast("bigint")
            end = start + F.char_length(F.get(x["whole"], i)).cast("bigint")
            span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
            ok = F.char_length(F.get(x["value"], i)) >= rule.at_least
            return F.struct(end.alias("at"), F.when(ok, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

        zero = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
        return F.when(F.size(x["whole"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(x["whole"]) - 1), zero, step, lambda s: s["out"])).otherwise(none)

    return F.element_at(F.transform(bound, one), 1)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """docs with ``_s_spans``: all spans by start, then by the rules' order."""
    keyed = docs.withColumn("_s_key", row_key(id_column, text)).withColumn("_s_text", F.coalesce(F.col(text), F.lit("")))
    asked = queries(rules)
    found = candidates(keyed, rules, "_s_text", "_s_key")
    joined = keyed.join(found, "_s_key", "left")
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    parts = []
    for n, rule in enumerate(rules):
        own = spans(F.col("_s_text"), rule, n)
        parts.append(F.when(F.expr(f"(_s_rules & {1 << n}L) <> 0"), own).otherwise(none) if n in asked else own)
    return joined.withColumn("_s_spans", F.array_sort(F.concat(*parts))).drop("_s_key", "_s_text", "_s_rules")


def _joined(found: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text: str = "text", id_column: str = "doc_id", mask: str = "[secret]") -> DataFrame:
    """docs with every span replaced by a mask; overlapping spans are merged first."""
    found = scan(docs, text=text, id_column=id_column)
    merged = F.expr(
        """aggregate(_s_spans, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, s) ->
             CASE WHEN size(acc) > 0 AND s.start <= element_at(acc, -1).end
                  THEN concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start AS start, greatest(element_at(acc, -1).end, s.end) AS end)))
                  ELSE concat(acc, array(struct(s.start AS start, s.end AS end))) END)"""
    )
    rebuilt = F.expr(
        f"""concat(array_join(transform(_s_merged, (s, i) ->
                substring(`{text}`, cast(if(i = 0, 0, get(_s_merged, i - 1).end) + 1 as int), cast(s.start - if(i = 0, 0, get(_s_merged, i - 1).end) as int))), '{mask}'),
              '{mask}', substring(`{text}`, cast(element_at(_s_merged, -1).end + 1 as int)))"""
    )
    return found.withColumn("_s_merged", merged).withColumn(text, F.when(F.size("_s_merged") > 0, rebuilt).otherwise(F.col(text))).drop("_s_merged", "_s_spans")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("_s_spans", lambda s: s["kind"] < BASE_KINDS)
    count = lambda n: F.size(F.filter("_s_spans", lambda s: s["kind"] == n)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(base, RULES), 256).alias("base_sha256"),
        _joined(F.col("_s_spans"), RULES).alias("spans"),
    )


def _oracle() -> str:
    """DuckDB SQL: every rule's regex over every text, without an index."""
    quoted = lambda s: s.replace("'", "''")
    lists = ",\n".join(
        f"regexp_extract_all(t, '{quoted(r.pattern)}') AS m{n}, regexp_extract_all(t, '{quoted(r.pattern)}', {r.group}) AS v{n}, string_split_regex(t, '{quoted(r.pattern)}') AS g{n}" for n, r in enumerate(RULES)
    )
    spans_ = ",\n".join(
        f"list_filter(list_transform(range(1, len(m{n}) + 1), lambda i: {{'s': list_sum(list_transform(g{n}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{n}[1:i-1], lambda x: length(x))), 0),"
        f" 'k': {n}, 'n': '{r.kind}', 'e': list_sum(list_transform(g{n}[1:i], lambda x: length(x))) + list_sum(list_transform(m{n}[1:i], lambda x: length(x))), 'v': length(v{n}[i])}}), lambda z: z.v >= {r.at_least}) AS s{n}"
        for n, r in enumerate(RULES)
    )
    text = lambda xs: f"array_to_string(list_transform(list_sort({xs}), lambda z: z.n || ':' || z.s::BIGINT || ':' || z.e::BIGINT), ',')"
    base = "list_concat(list_concat(s0, s1), s2)"
    every = "s0"
    for n in range(1, len(RULES)):
        every = f"list_concat({every}, s{n})"
    return f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS (SELECT doc_id, {lists} FROM a), c AS (SELECT doc_id, {spans_} FROM b)
SELECT doc_id, len(s0)::BIGINT AS n_assign, len(s1)::BIGINT AS n_access, len(s2)::BIGINT AS n_hex, sha256({text(base)}) AS base_sha256, {text(every)} AS spans FROM c"""


ORACLE_SQL = _oracle()
