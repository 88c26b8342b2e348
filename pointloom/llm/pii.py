"""Personal data: high-recall generators propose spans, boosted trees score them by format and context, thresholds choose.

Everything that touches documents is a column expression. Base kinds (email, ip, card, phone) are always kept; generators propose more
(secret, hex, number, mail, iban), which may overlap, and one model for each, trained on a bounded set of made-up snippets whose
features the same expressions compute, decides. Positions count code points, ends are exclusive.

Null text: empty, no spans. Null doc_id and repeated rows: each row is judged by itself. Nothing is shuffled.
"""

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import boosting

SPAN = "array<struct<start:int,stop:int,value:string>>"
#: Matches whose places are summed one after the other.
SPAN_BLOCK = 128
#: Patterns match what the plain ones in the comments match, without trying a run again from each of its characters.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that any match passes.
HINT = {"email": "instr(text, '@') > 0", "ip": "instr(text, '.') > 0", "card": "true", "phone": "instr(text, '+') > 0"}
DIGITS = "regexp_replace({0}, '[^0-9]', '')"
LUHN = (
    "aggregate(sequence(1, length({0})), 0, (s, i) -> s + IF(i % 2 = 1, int(substr({0}, length({0}) - i + 1, 1)),"
    " element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), int(substr({0}, length({0}) - i + 1, 1)) + 1))) % 10 = 0"
)
VALID = {
    "email": "true",
    "ip": r"forall(split(m.value, '\\.'), p -> length(ltrim('0', p)) <= 3 AND coalesce(int(nullif(ltrim('0', left(ltrim('0', p), 3)), '')), 0) <= 255)",
    "card": f"length({DIGITS.format('m.value')}) BETWEEN 12 AND 19 AND {LUHN.format(DIGITS.format('m.value'))}",
    "phone": f"length({DIGITS.format('m.value')}) BETWEEN 9 AND 15",
}
WORD = "A-Za-z0-9"
GENERATORS = {
    "secret": r"(?i)(?<![a-z])(?:pass(?:word|wd|phrase)?|pwd|token|secret|key|auth|credential)s?[\"']?\s{0,3}[:=]\s{0,3}[\"']?[^\s\"',;]{4,}+",
    "hex": rf"(?<![{WORD}])(?=[0-9]*+[a-f])[0-9a-f]{{16,}}+(?![{WORD}])",
    "number": rf"(?<![{WORD}.+])\(?[0-9](?:[ ().-]{{0,2}}[0-9]){{6,}}+(?![{WORD}])",
    "mail": rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\s?(?:\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]++(?:\s?(?:\(dot\)|\[dot\]|\sdot\s|\.)\s?[A-Za-z]++){{1,3}}+",
    "iban": rf"(?<![{WORD}])[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}+(?: ?[A-Z0-9]{{1,3}})?(?![{WORD}])",
}
GENERATOR_HINT = {"secret": "text rlike '[:=]'", "hex": "true", "number": "text rlike '[0-9]'", "mail": "text rlike '[(\\\\[\\\\s]at[)\\\\]\\\\s]'", "iban": "text rlike '[A-Z][A-Z][0-9]'"}
KINDS = [*BASE, *GENERATORS]
CONTEXT = 40
#: What the trees see of a span c with the text before it.
FEATURES = {
    "size": "length(c.value)",
    "digits": f"length({DIGITS.format('c.value')})",
    "letters": "length(regexp_replace(c.value, '[^A-Za-z]', ''))",
    "spaces": "length(regexp_replace(c.value, '[^ ]', ''))",
    "dots": "length(regexp_replace(c.value, '[^.]', ''))",
    "dashes": "length(regexp_replace(c.value, '[^-]', ''))",
    "brackets": "length(regexp_replace(c.value, '[^()\\\\[\\\\]]', ''))",
    "mixed": "int(regexp_replace(c.value, '^.*[:=]', '') rlike '[0-9][A-Za-z]|[A-Za-z][0-9]')",
    "dated": "int(c.value rlike '^(19|20)[0-9][0-9][-./][01][0-9]')",
    "grouped": "int(c.value rlike '(^|[^0-9])[0-9]{3}[).]?[ -]?[0-9]{2,4}[ .-][0-9]{4}($|[^0-9])')",
    "spelled": "int(c.value rlike '[ \\\\[(]dot[ \\\\])]')",
    "tail": "length(regexp_extract(c.value, '[A-Za-z]*$', 0))",
    "named": "int(lower(c.context) rlike '(phone|tel|call|mobile|fax|ssn|social|passport|card|account|mail|contact|iban|bank|reach|write)')",
    "counted": "int(lower(c.context) rlike '(order|item|version|page|total|isbn|part|serial|units|build|ratio|pi)[^a-z]*$')",
}
#: Snippets that train the models, at most; the seed makes them the same everywhere.
SNIPPETS, SEED = 160, 20


def _spans(pattern: str, hint: str) -> Column:
    """Matches in column text from the left without overlaps: the gaps between them give the places.

    Lengths are summed by blocks of matches, then over blocks, then inside them: appending to one list would cost the square of the matches.
    """
    pieces = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hit"))
    width = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))
    of_block = lambda all_, k: F.slice(all_, k * SPAN_BLOCK + 1, F.lit(SPAN_BLOCK))

    def begin(a, x):
        return F.struct((a["pos"] + x).alias("pos"), F.concat(a["out"], F.array(a["pos"])).alias("out"))

    def step(a, x):
        start, stop = a["pos"] + F.length(x["gap"]), a["pos"] + width(x)
        span = F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("value"))
        return F.struct(stop.alias("pos"), F.when(x["hit"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(span))).alias("out"))

    none = F.expr(f"cast(array() AS {SPAN})")
    start = lambda pos, kind: F.struct(pos.alias("pos"), F.expr(f"cast(array() AS {kind})").alias("out"))

    def found(all_):
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / SPAN_BLOCK).cast("int"))
        sums = F.transform(blocks, lambda k: F.aggregate(of_block(all_, k), F.lit(0), lambda a, x: a + width(x)))
        offsets = F.aggregate(sums, start(F.lit(0), "array<int>"), begin, lambda a: a["out"])
        numbered = F.arrays_zip(blocks.alias("k"), offsets.alias("at"))
        return F.flatten(F.transform(numbered, lambda b: F.aggregate(of_block(all_, b["k"]), start(b["at"], SPAN), step, lambda a: a["out"])))

    # The pieces are made once: a list of one is transformed.
    once = F.flatten(F.transform(F.array(pieces), found))
    return F.when(F.expr(hint) & F.col("text").rlike(pattern), once).otherwise(none)


def _proposed(docs: DataFrame) -> DataFrame:
    """Candidates of every generator with their features, in columns c_<kind>."""
    fields = ", ".join(f"'{n}', double({e})" for n, e in FEATURES.items())
    for kind, pattern in GENERATORS.items():
        docs = docs.withColumn(f"s_{kind}", _spans(pattern, GENERATOR_HINT[kind]))
        context = f"transform(s_{kind}, s -> named_struct('start', s.start, 'stop', s.stop, 'value', s.value, 'context', substr(text, greatest(1, s.start + 1 - {CONTEXT}), s.start - greatest(0, s.start - {CONTEXT}))))"
        docs = docs.withColumn(f"s_{kind}", F.expr(context))
        docs = docs.withColumn(f"c_{kind}", F.expr(f"transform(s_{kind}, c -> named_struct('start', c.start, 'stop', c.stop, {fields}))")).drop(f"s_{kind}")
    return docs


def snippets() -> list[tuple[str, str, int]]:
    """(kind, text with one span of it, 1 if that is personal data)."""
    rng = random.Random(SEED)
    pick, word = rng.choice, lambda: "".join(rng.choice("aeioulrstnmd") for _ in range(rng.randrange(2, 9)))
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    say = lambda x: f"{word()} {word()} {x} {word()} {word()}."
    out = []
    for _ in range(SNIPPETS // 2):
        out += [
            ("secret", say(pick(["password={}", 'token = "{}"', "api_key: {}", "secret={}", "pwd: {}"]).format(hexed(rng.randrange(10, 41)))), 1),
            ("secret", say(pick(["password: {}", "the key: {}", "token = {}", "keys: {}"]).format(word() + "ing")), 0),
            ("hex", say(pick(["{}", '"{}"', "key {}"]).format("a" + hexed(rng.randrange(31, 64)))), 1),
            ("hex", say(pick(["facade" * 3, "deadbeef" * 2, "c" + "0" * 15, "f" * rng.randrange(16, 20)])), 0),
            ("number", say(pick([f"phone ({num(3)}) {num(3)}-{num(4)}", f"call {num(3)}-{num(3)}-{num(4)}", f"ssn {num(3)}-{num(2)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"tel {num(3)} {num(3)} {num(4)}", f"account {num(10)}"])), 1),
            ("number", say(pick([f"20{num(2)}-0{pick('123456789')}-1{num(1)}", f"20{num(2)}.1{pick('012')}.2{num(1)} 10", f"order {num(8)}", f"item {num(7)}", f"pi 3.{num(9)}", f"{num(1)}.{num(8)}", f"version {num(2)}.{num(2)}.{num(4)}", f"{pick('123456789')}{num(7)}", f"total {num(3)} {num(3)} {num(3)}"])), 0),
            ("mail", say(pick(["{} at {} dot com", "{} [at] {} [dot] org", "{} (at) {}.net", "{}(at){}(dot)de", "mail {} at {} dot edu"]).format(word(), word())), 1),
            ("mail", say(pick(["{} at {}. Then", "{} at {}. The", "look at {}. A", "{} at {}.{}"]).format(word(), word(), word() + "ly")), 0),
            ("iban", say(pick(["iban ", "bank ", ""]) + pick(["DE", "FR", "ES", "GB"]) + num(2) + " " + " ".join(num(4) for _ in range(4)) + " " + num(2)), 1),
            ("iban", say(pick(["AB", "XQ"]) + num(2) + " " + " ".join("".join(pick("ABCDEFGHXYZ") for _ in range(4)) for _ in range(4))), 0),
        ]
    return out


def train(spark: SparkSession) -> dict[str, boosting.Boosted]:
    """A model for each generator."""
    made = snippets()
    table = json.dumps([{"k": k, "text": t, "y": y} for k, t, y in made])
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(table), "array<struct<k:string,text:string,y:int>>")).alias("r")).select("r.*")
    scored = _proposed(rows).select("k", "y", *(F.get(f"c_{kind}", F.lit(0)).alias(kind) for kind in GENERATORS))
    got = [r for r in scored.collect()]
    models = {}
    for kind in GENERATORS:
        own = [(r[kind], r["y"]) for r in got if r["k"] == kind and r[kind] is not None]
        x = np.array([[c[n] for n in FEATURES] for c, _ in own])
        models[kind] = boosting.train(x, np.array([y for _, y in own]), list(FEATURES))
    return models


def find(docs: DataFrame, models: dict[str, boosting.Boosted] | None = None, text_column: str = "text") -> DataFrame:
    """docs with column spans added: array of (start, rank of the kind, kind, stop), sorted; base spans and chosen candidates."""
    models = models or train(docs.sparkSession)
    was = docs.columns
    keep = F.struct(*(docs[c] for c in was)).alias("row")
    df = docs.select(keep, F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    for kind, pattern in BASE.items():
        df = df.withColumn(f"s_{kind}", _spans(pattern, HINT[kind]))
        df = df.withColumn(f"b_{kind}", F.expr(f"transform(filter(s_{kind}, m -> {VALID[kind]}), m -> named_struct('start', m.start, 'rank', {KINDS.index(kind)}, 'kind', '{kind}', 'stop', m.stop))")).drop(f"s_{kind}")
    df = _proposed(df)
    for kind, model in models.items():
        chance = f"1 / (1 + exp(-({model.a!r}D * ({model.margin_sql('c.')}) + {model.b!r}D)))"
        df = df.withColumn(f"c_{kind}", F.expr(f"transform(filter(c_{kind}, c -> {chance} >= {model.threshold!r}D), c -> named_struct('start', c.start, 'rank', {KINDS.index(kind)}, 'kind', '{kind}', 'stop', c.stop))"))
    base = F.array_sort(F.concat(*(F.col(f"b_{k}") for k in BASE)))
    df = df.withColumn("base_spans", base).withColumn("all_spans", F.array_sort(F.concat("base_spans", *(F.col(f"c_{k}") for k in GENERATORS))))
    return df.select(*(F.col("row")[c].alias(c) for c in was), F.col("base_spans"), F.col("all_spans").alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')")


def redacted(text: str, spans: str) -> Column:
    """The text with each span, or overlapping run of spans, replaced by its first kind in brackets."""
    step = f"(a, s) -> named_struct('pos', greatest(a.pos, s.stop), 'out', IF(s.start >= a.pos, concat(a.out, substr({text}, a.pos + 1, s.start - a.pos), '[', upper(s.kind), ']'), a.out))"
    return F.expr(f"IF(size({spans}) = 0, {text}, aggregate({spans}, named_struct('pos', 0, 'out', ''), {step}, a -> concat(a.out, substr({text}, a.pos + 1))))")


def digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", models=None) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and spans."""
    found = find(docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")), models)
    counts = [F.expr(f"bigint(size(filter(base_spans, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in BASE]
    return found.select(F.col("doc_id").alias(id_column), *counts, F.sha2(written("base_spans"), 256).alias("base_sha256"), written("spans").alias("spans"))
