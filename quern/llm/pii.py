"""Personal data by weak supervision, with DataFrame functions only.

Expressions find candidate spans. Base kinds (email, ip, card, phone) are always kept. On each candidate of the added
kinds (name, local_phone, national_id) three labelers vote yes, no, or no opinion: one looks at its form, one compares it
with word lists, one reads the words before it. The votes are counted over the whole table by kind and pattern, of which there
are only some hundreds whatever the size of the table; expectation-maximisation over these counts estimates how reliable
each labeler is for each kind and how likely each pattern is personal data. With these probabilities for labels
a span classifier is trained, a naive Bayes model that besides the votes knows a span's shape and the character before
it, and it judges each span in place. Candidates are written to the shared folder once, so texts are read once.

Expressions are written so that Java's matcher neither recurses nor starts anew inside a run of
characters it has already tried: very long runs cost time in proportion to their length. Where in a text
a match lies follows from the lengths of what lies between matches.

Defined cases: null text is empty; empty texts give no spans; repeated rows are judged each on their own;
an empty table gives an empty result; very long texts are read whole; other columns are never looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import id_and_text, table, written

# Word lists.
FIRST_NAMES = (
    "Adam Alice Amanda Andrea Andrew Anna Anthony Barbara Benjamin Betty Brian Carol Carlos Catherine Charles Charlotte Christine Christopher "
    "Claire Daniel David Deborah Dennis Diana Donald Donna Dorothy Edward Elizabeth Emily Emma Eric Eva Frank Gary George Hannah Hans Helen "
    "Henry Isabel Jacob James Jane Janet Jason Jean Jennifer Jessica Joan John Jose Joseph Joshua Juan Julia Karen Karl Kathleen Kenneth Kevin "
    "Klaus Larry Laura Lisa Louis Lucia Maria Marie Mark Martha Martin Mary Matthew Michael Michelle Nancy Nicole Olivia Pamela Patricia Paul "
    "Peter Pierre Rachel Rebecca Richard Robert Ronald Ruth Samantha Samuel Sandra Sarah Scott Sharon Sophie Stephanie Stephen Steven Susan "
    "Thomas Timothy Victoria Walter William"
).split()
TOP_DOMAINS = "com org net edu gov io co info biz me de fr es it uk eu nl ch at be pl us ca au in jp br mx ru".split()
#: Words that begin sentences or stand in names of things.
COMMON_WORDS = (
    "A An And As At By For From He Her His How If In It Its My No Not Of On Or Our She So That The Their There These They This To We What When Where "
    "Who Why With You Your January February March April May June July August September October November December Monday Tuesday Wednesday Thursday "
    "Friday Saturday Sunday North South East West New General Public License University College Street Road Company Project Software Foundation"
).split()
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame"

_LOCAL = "[A-Za-z0-9._%+-]"
#: Kind: a test that is cheap on texts without the kind, the candidates' expression.
KINDS: dict[str, tuple[str, str]] = {
    "email": (r"@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"),
    "card": (r"[0-9](?:[ -]?[0-9]){12}", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    "name": (r"[A-Z][a-z]+ [A-Z][a-z]|[a-z]\. [A-Z]", rf"(?:(?:{TITLES})\.? )?[A-Z][a-z]++(?: [A-Z][a-z]++)++|(?:{TITLES})\.? [A-Z][a-z]++"),
    "local_phone": (r"[0-9][.-][0-9]", r"(?:\([0-9]{3}\) ?)?[0-9]++(?:[.-][0-9]++)++"),
    "national_id": (r"[0-9]-[0-9]", r"[0-9]++(?:[.-][0-9]++)++"),
}
#: Of an added kind: words before a span that speak for it, and against it.
NEARBY = {
    "name": ("name|contact|dear|signed|by|author|from|regards", "the|of|under|university|city"),
    "local_phone": ("phone|tel|call|mobile|fax|cell|contact", "order|invoice|ref|item|isbn|serial|version|page"),
    "national_id": ("ssn|social|security|id|number", "order|invoice|ref|item|isbn|serial|version|page"),
}
#: What a match of an added number must be: runs that are longer or parted otherwise are something else.
WHOLE = {"local_phone": r"^(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}$", "national_id": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"}
# Numbers that are given in examples.
SAMPLES = ("123-45-6789", "078-05-1120", "219-09-9999")
BASE = ("email", "ip", "card", "phone")
ADDED = tuple(k for k in KINDS if k not in BASE)
LABELERS = ("form", "lists", "context")
FEATURES = (*LABELERS, "shape", "edge")
_SPAN = "array<struct<start:bigint,end:bigint,value:string,near:string>>"
_VOTED = "array<struct<kind:string,start:bigint,end:bigint,form:int,lists:int,context:int,shape:string,edge:string>>"
#: Characters before a span, back to the span of its kind before it, that the context labeler reads.
NEAR = 24
#: Matches whose places are added up at a time.
BLOCK = 256


def _places(text: Column, test: str, pattern: str) -> Column:
    """All leftmost non-overlapping matches with their places in code points, and the characters just before each.

    Lengths of gaps and matches are added up in blocks of BLOCK matches, first within each block, then over the
    blocks' sums, so that no array grows match by match: the work is in proportion to the text and its matches.
    """
    none = F.array().cast(_SPAN)
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, value: F.struct(F.length(gap).cast("long").alias("gap"), F.right(gap, F.lit(NEAR)).alias("near"), value.alias("value")))
    # The text behind the last match has no match of its own; what it came with goes.
    pairs = F.filter(pieces, lambda x: x["value"].isNotNull())

    def within(pairs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(pairs), F.lit(BLOCK))
        return F.transform(F.when(F.size(pairs) > 0, starts).otherwise(F.array().cast("array<int>")), lambda i: F.slice(pairs, i, F.lit(BLOCK)))

    length = lambda x: x["gap"] + F.length(x["value"])

    def placed(block: Column, first: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.length(x["value"])
            return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["near"].alias("near"))).alias("out"))

        return F.aggregate(block, F.struct(first.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def all_placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + length(x)))
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        firsts = F.aggregate(sums, begin, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, firsts, placed))

    # A transform over one element gives the blocks a name, so that they are made once.
    found = F.flatten(F.transform(F.array(pairs), lambda p: F.flatten(F.transform(F.array(within(p)), all_placed))))
    return F.when(F.contains(text, F.lit(test)) if test == "@" else text.rlike(test), found).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        x = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _holds(kind: str, x: Column) -> Column:
    """What a match must satisfy to be a candidate, or for a base kind a span."""
    value = x["value"]
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^[0-9]{1,3}$") & (F.substring(F.lpad(F.regexp_replace(p, "^0+(?=[0-9])", ""), 3, "0"), 1, 3) <= "255"))
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "name":  # does not begin inside a word
        return ~x["near"].rlike("[A-Za-z]$")
    if kind in WHOLE:  # nor behind another number
        return value.rlike(WHOLE[kind]) & ~x["near"].rlike("[0-9+][ .-]?$")
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    """1 yes, 0 no, 2 no opinion."""
    return F.when(yes, 1).when(no, 0).otherwise(2)


def _name_words(value: Column) -> Column:
    return F.split(F.regexp_replace(value, rf"^(?:{TITLES})\.? ", ""), " ")


def _form(kind: str, value: Column) -> Column:
    d = _digits(value)
    if kind == "name":
        words = _name_words(value)
        n, once = F.size(words), F.size(F.array_distinct(words)) == F.size(words)
        return _vote(value.rlike(rf"^(?:{TITLES})\.? ") & once, (n > 4) | ~once)
    if kind == "local_phone":
        return _vote(d.rlike("^[2-9]..[2-9]"), d.rlike("^[01]"))
    return _vote(~d.rlike("^(?:000|666|9)|^...00|0000$"), F.lit(True))


def _lists(kind: str, value: Column) -> Column:
    if kind == "name":
        words = _name_words(value)
        return _vote(F.element_at(words, 1).isin(FIRST_NAMES), F.arrays_overlap(words, F.array(*map(F.lit, COMMON_WORDS))))
    if kind == "local_phone":
        return _vote(F.lit(False), _digits(value).rlike("^(...)?555"))
    return _vote(F.lit(False), value.isin(*SAMPLES))


def _shape(kind: str, value: Column) -> Column:
    """A few values for each kind: a name's title and number of words, what parts a number."""
    if kind == "name":
        return F.concat(F.when(value.rlike(rf"^(?:{TITLES})\.? "), "t").otherwise(""), F.least(F.size(_name_words(value)), F.lit(5)).cast("string"))
    return F.when(value.startswith("("), "p").when(value.contains("."), "d").otherwise("h")


def _edge(near: Column) -> Column:
    return F.when(near == "", "start").when(near.endswith(" "), "space").otherwise("mark")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and all candidate spans, those of added kinds with votes and features, base kinds first, each kind by place."""
    given = id_and_text(docs, id_col, text_col)
    text = F.col("text")

    def of_kind(kind: str, test: str, pattern: str) -> Column:
        def voted(x: Column) -> Column:
            at = [F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")]
            if kind in BASE:
                return F.struct(*at, *[F.lit(2).alias(k) for k in LABELERS], F.lit("").alias("shape"), F.lit("").alias("edge"))
            yes, no = (F.lower(x["near"]).rlike(f"(?:^|[^a-z])(?:{words})") for words in NEARBY[kind])
            return F.struct(*at, _form(kind, x["value"]).alias("form"), _lists(kind, x["value"]).alias("lists"), _vote(yes, no).alias("context"), _shape(kind, x["value"]).alias("shape"), _edge(x["near"]).alias("edge"))

        spans = _places(text, test, pattern)
        if kind != "email":
            spans = F.filter(spans, lambda x: _holds(kind, x))
        return F.transform(spans, voted).cast(_VOTED)

    return given.select("doc_id", F.concat(*[of_kind(kind, *how) for kind, how in KINDS.items()]).alias("spans"))


def patterns(found: DataFrame) -> dict[tuple, int]:
    """How often each added kind has each combination of votes and features: some hundreds of rows at most."""
    rows = found.select(F.explode("spans").alias("s")).filter(F.col("s.kind").isin(*ADDED)).groupBy("s.kind", *[f"s.{x}" for x in FEATURES]).count().collect()
    return {tuple(r)[:-1]: r["count"] for r in rows}


#: Rounds of expectation-maximisation; the share of right candidates that it starts from.
ROUNDS, PRIOR = 50, 0.3


def expectation_maximisation(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS, prior: float = PRIOR) -> dict[tuple[int, ...], float]:
    """The probability that a span with these votes is right; votes are independent given the truth.

    Starts from labelers that are right rather than wrong; a weak prior keeps all rates inside (0, 1). Whatever the
    counts, no opinion says nothing and no labeler is worse than chance: rates that would say so are made equal.
    """
    rate = {(k, truth, v): (0.7 if v == truth else 0.1 if v < 2 else 0.2) for k in range(3) for truth in (0, 1) for v in range(3)}
    share, out = prior, {}
    for _ in range(rounds):
        for votes in counts:
            yes, no = share, 1 - share
            for k, v in enumerate(votes):
                yes *= rate[k, 1, v]
                no *= rate[k, 0, v]
            out[votes] = yes / (yes + no)
        total = sum(counts.values())
        right = sum(n * out[v] for v, n in counts.items())
        share = (right + prior) / (total + 1)
        for k in range(3):
            for truth, weight in ((1, right), (0, total - right)):
                for v in range(3):
                    hits = sum(n * (out[x] if truth else 1 - out[x]) for x, n in counts.items() if x[k] == v)
                    # The pull is towards a labeler that is right.
                    rate[k, truth, v] = (hits + (2 if v == truth else 0.5)) / (weight + 3)
            for v in range(3):
                yes, no = rate[k, 1, v], rate[k, 0, v]
                if v == 2 or (yes < no if v else yes > no):
                    rate[k, 1, v] = rate[k, 0, v] = (yes + no) / 2
    return out


def train(counts: dict[tuple, int]) -> dict[tuple, float]:
    """Weights of the span classifier by (kind, feature, value), and by (kind,) the weight of the kind itself.

    A naive Bayes model: for each feature how much more frequent a value is among right spans than among wrong ones, where each
    pattern is right as far as expectation-maximisation says. Votes count for what they say or not at all.
    """
    out: dict[tuple, float] = {}
    for kind in ADDED:
        own = {k[1:]: n for k, n in counts.items() if k[0] == kind}
        votes: dict[tuple[int, ...], int] = {}
        for k, n in own.items():
            votes[k[:3]] = votes.get(k[:3], 0) + n
        soft = expectation_maximisation(votes) if votes else {}
        right = sum(n * soft[k[:3]] for k, n in own.items())
        wrong = sum(n * (1 - soft[k[:3]]) for k, n in own.items())
        if own:
            out[kind,] = math.log((right + 1) / (wrong + 1))
        for i, name in enumerate(FEATURES):
            for value in sorted({k[i] for k in own}):
                yes = sum(n * soft[k[:3]] for k, n in own.items() if k[i] == value)
                no = sum(n * (1 - soft[k[:3]]) for k, n in own.items() if k[i] == value)
                w = math.log((yes + 1) / (right + 2)) - math.log((no + 1) / (wrong + 2))
                out[kind, name, value] = w if name not in LABELERS else max(w, 0.0) if value == 1 else min(w, 0.0) if value == 0 else 0.0
    return out


def _score(weights: dict[tuple, float], x: Column) -> Column:
    total = F.lit(0.0)
    for f, w in weights.items():
        hit = (x["kind"] == f[0]) if len(f) == 1 else (x["kind"] == f[0]) & (x[f[1]] == f[2])
        total = total + F.when(hit, F.lit(w)).otherwise(F.lit(0.0))
    return total


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: kind, start, end of all base spans and of the added ones that the classifier takes."""
    found = written(candidates(docs, id_col, text_col), "candidates")
    weights = train(patterns(found))
    taken = F.filter("spans", lambda x: x["kind"].isin(*BASE) | (_score(weights, x) > 0))
    return found.select("doc_id", F.transform(taken, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def op1_of(docs: DataFrame) -> DataFrame:
    found = find_pii(docs)
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(*BASE))).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_of(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same in SQL: matches with their gaps, votes, expectation-maximisation as a recursion over the counted votes, the classifier as sums over windows."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]", **{kind: KINDS[kind][1].replace("++", "+") for kind in ADDED},
    }
    matches = " UNION ALL ".join(f"SELECT r, '{kind}' AS kind, {k} AS o, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m FROM d WHERE regexp_matches(t, '{p}')" for k, (kind, p) in enumerate(plain.items()))
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digits}[-i]::INT ELSE 2 * {digits}[-i]::INT - CASE WHEN {digits}[-i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    octets = "len(list_filter(string_split(v, '.'), lambda x: NOT CASE WHEN len(ltrim(x, '0')) > 3 THEN false WHEN ltrim(x, '0') = '' THEN true ELSE ltrim(x, '0')::INT <= 255 END)) = 0"
    number = " ".join(f"WHEN '{kind}' THEN regexp_matches(v, '{p}') AND NOT regexp_matches(near, '[0-9+][ .-]?$')" for kind, p in WHOLE.items())
    holds = f"CASE kind WHEN 'ip' THEN {octets} WHEN 'card' THEN CASE WHEN len({digits}) BETWEEN 13 AND 19 THEN {luhn} ELSE false END WHEN 'phone' THEN len({digits}) BETWEEN 9 AND 15 WHEN 'name' THEN NOT regexp_matches(near, '[A-Za-z]$') {number} ELSE true END"
    title = f"regexp_matches(v, '^(?:{TITLES})\\.? ')"
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    vote = lambda yes, no: f"CASE WHEN {yes} THEN 1 WHEN {no} THEN 0 ELSE 2 END"
    bad = f"regexp_matches({digits}, '^(?:000|666|9)|^...00|0000$')"
    form = f"CASE kind WHEN 'name' THEN {vote(f'{title} AND len(list_distinct(w)) = len(w)', 'len(w) > 4 OR len(list_distinct(w)) < len(w)')} WHEN 'local_phone' THEN {vote(f"regexp_matches({digits}, '^[2-9]..[2-9]')", f"regexp_matches({digits}, '^[01]')")} ELSE {vote('NOT ' + bad, 'true')} END"
    lists = f"CASE kind WHEN 'name' THEN {vote(f'list_contains({listed(FIRST_NAMES)}, w[1])', f'list_has_any(w, {listed(COMMON_WORDS)})')} WHEN 'local_phone' THEN {vote('false', f"regexp_matches({digits}, '^(...)?555')")} ELSE {vote('false', f'list_contains({listed(SAMPLES)}, v)')} END"
    near = lambda words: f"regexp_matches(lower(near), '(?:^|[^a-z])(?:{words})')"
    context = "CASE kind " + " ".join(f"WHEN '{kind}' THEN {vote(near(yes), near(no))}" for kind, (yes, no) in NEARBY.items()) + " END"
    shape = f"CASE WHEN kind = 'name' THEN CASE WHEN {title} THEN 't' ELSE '' END || least(len(w), 5) WHEN v LIKE '(%' THEN 'p' WHEN contains(v, '.') THEN 'd' ELSE 'h' END"
    start = {(truth, v): 0.7 if v == truth else 0.1 if v < 2 else 0.2 for truth in (0, 1) for v in range(3)}
    first = lambda truth: " * ".join(f"CASE {x} WHEN 0 THEN {start[truth, 0]} WHEN 1 THEN {start[truth, 1]} ELSE {start[truth, 2]} END" for x in LABELERS)
    rate = lambda truth, x: f"(sum({'n * p' if truth else 'n * (1 - p)'}) OVER (PARTITION BY kind, {x}) + CASE WHEN {x} = {truth} THEN 2 ELSE 0.5 END) / (sum({'n * p' if truth else 'n * (1 - p)'}) OVER (PARTITION BY kind) + 3)"
    share = f"(sum(n * p) OVER (PARTITION BY kind) + {PRIOR}) / (sum(n) OVER (PARTITION BY kind) + 1)"
    rates = ", ".join(f"{rate(truth, x)} AS {x}{truth}" for truth in (0, 1) for x in LABELERS)
    even = lambda x: f"({x} = 2 OR {x} = 1 AND {x}1 < {x}0 OR {x} = 0 AND {x}1 > {x}0)"
    both = [" * ".join(f"CASE WHEN {even(x)} THEN ({x}0 + {x}1) / 2 ELSE {x}{truth} END" for x in LABELERS) for truth in (0, 1)]
    weight = lambda x: f"ln((sum(n * p) OVER (PARTITION BY kind, {x}) + 1) / (sum(n * p) OVER (PARTITION BY kind) + 2)) - ln((sum(n * (1 - p)) OVER (PARTITION BY kind, {x}) + 1) / (sum(n * (1 - p)) OVER (PARTITION BY kind) + 2))"
    judged = " + ".join(f"CASE {x} WHEN 1 THEN greatest({weight(x)}, 0) WHEN 0 THEN least({weight(x)}, 0) ELSE 0 END" if x in LABELERS else weight(x) for x in FEATURES)
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({matches}),
u AS (SELECT r, kind, o, unnest(range(1, len(m) + 1)) AS i, unnest(g[1:len(m)]) AS gap, unnest(m) AS v FROM k),
s AS (SELECT r, kind, o, v, right(gap, {NEAR}) AS near, (sum(len(gap) + len(v)) OVER (PARTITION BY r, kind ORDER BY i) - len(v))::BIGINT AS a FROM u),
h AS MATERIALIZED (SELECT *, CASE WHEN kind = 'name' THEN string_split(regexp_replace(v, '^(?:{TITLES})\\.? ', ''), ' ') END AS w FROM s WHERE {holds}),
added AS MATERIALIZED (SELECT r, kind, o, a, v, {form} AS form, {lists} AS lists, {context} AS context, {shape} AS shape, CASE WHEN near = '' THEN 'start' WHEN near LIKE '% ' THEN 'space' ELSE 'mark' END AS edge FROM h WHERE o >= {len(BASE)}),
votes AS (SELECT kind, form, lists, context, count(*)::DOUBLE AS n FROM added GROUP BY ALL),
em AS (
  SELECT 1 AS round, kind, form, lists, context, n, {PRIOR} * {first(1)} / ({PRIOR} * {first(1)} + {1 - PRIOR} * {first(0)}) AS p FROM votes
  UNION ALL
  SELECT round + 1, kind, form, lists, context, n, share * yes / (share * yes + (1 - share) * no) FROM (
    SELECT *, {both[1]} AS yes, {both[0]} AS no FROM (SELECT round, kind, form, lists, context, n, {share} AS share, {rates} FROM em WHERE round < {ROUNDS}))
),
patterns AS (SELECT kind, form, lists, context, shape, edge, count(*)::DOUBLE AS n FROM added GROUP BY ALL),
judged AS (
  SELECT kind, form, lists, context, shape, edge, ln((sum(n * p) OVER (PARTITION BY kind) + 1) / (sum(n * (1 - p)) OVER (PARTITION BY kind) + 1)) + {judged} AS score
  FROM (SELECT q.*, p FROM patterns q JOIN em USING (kind, form, lists, context) WHERE round = {ROUNDS})
),
spans AS (
  SELECT r, kind, o, a, kind || ':' || a || ':' || (a + len(v)) AS x FROM h WHERE o < {len(BASE)}
  UNION ALL SELECT r, kind, o, a, kind || ':' || a || ':' || (a + len(v)) FROM added JOIN judged USING (kind, form, lists, context, shape, edge) WHERE score > 0
),
n AS (SELECT r, {", ".join(f"count(*) FILTER (o = {k}) AS n_{kind}" for k, kind in enumerate(BASE))}, string_agg(x, ',' ORDER BY o, a) FILTER (o < {len(BASE)}) AS base, string_agg(x, ',' ORDER BY o, a) AS spans FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN n USING (r)
"""


QUERIES = {"op1_pii": op1_pii}
ORACLES = {"op1_pii": _sql()}
