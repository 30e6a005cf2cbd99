"""Bytes, records and messages before they become facts: encodings, cleaning chains, type inference, mail threads, sources
of values, guides to conflicts, translated values and gates before pairs are scored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Byte order marks (hexadecimal) and the encodings they announce.
MARKS = {"EFBBBF": "UTF-8", "FFFE": "UTF-16LE", "FEFF": "UTF-16BE"}

# Names of causal relations and the one they are stored under.
CAUSAL_TYPES = {"CAUSES": "CAUSED", "CAUSED": "CAUSED", "INFLUENCES": "INFLUENCED", "INFLUENCED": "INFLUENCED", "PRECEDES": "PRECEDENT_FOR", "PRECEDENT_FOR": "PRECEDENT_FOR"}


def decode(data: Column) -> Column:
    """Struct ``encoding, marked, text`` of bytes: by their byte order mark, else UTF-8 where valid, else ISO-8859-1."""
    head = F.hex(F.substring(data, 1, 3))
    rest = lambda n: F.substring(data, n + 1, F.octet_length(data))
    plain = F.is_valid_utf8(data.cast("string"))
    encoding, text = F.when(plain, "UTF-8").otherwise("ISO-8859-1"), F.when(plain, data.cast("string")).otherwise(F.decode(data, "ISO-8859-1"))
    marked = F.lit(False)
    for mark, name in MARKS.items():
        hit = head.startswith(mark)
        body = rest(len(mark) // 2)
        read = F.make_valid_utf8(body.cast("string")) if name == "UTF-8" else F.decode(body, name)
        encoding, text, marked = F.when(hit, name).otherwise(encoding), F.when(hit, read).otherwise(text), marked | hit
    return F.when(data.isNotNull(), F.struct(encoding.alias("encoding"), marked.alias("marked"), text.alias("text")))


def clean(records: DataFrame, key: str, required: list[str], fills: dict[str, object], order: str) -> DataFrame:
    """Deduplicate, validate, fill: one record of each ``key`` (the least ``order``), only with all ``required`` fields not blank, other nulls filled. Copies meet before the shuffle, so a key may hold any share of the rows."""
    rest = [c for c in records.columns if c not in (key, order)]
    first = records.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("__first")).select(key, "__first.*")
    filled = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    valid = first.where(reduce(lambda a, b: a & b, map(filled, required)))
    return valid.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def column_types(records: DataFrame) -> DataFrame:
    """``field, type, n, nulls``: the narrowest of integer, double, boolean, timestamp and string that reads every value of a text column; one aggregation, no row leaves it."""
    readers = {"integer": "bigint", "double": "double", "boolean": "boolean", "timestamp": "timestamp"}
    text = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in records.columns}
    sums = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(records.columns):
        sums.append(F.count(text[c]).alias(f"v{i}"))
        sums += [F.count(text[c].try_cast(t)).alias(f"{name}{i}") for name, t in readers.items()]
    one = records.agg(*sums)
    rows = []
    for i, c in enumerate(records.columns):
        kind = F.lit("string")
        for name in reversed(readers):
            kind = F.when((F.col(f"v{i}") > 0) & (F.col(f"{name}{i}") == F.col(f"v{i}")), name).otherwise(kind)
        rows.append(F.struct(F.lit(c).alias("field"), kind.alias("type"), F.col("__n").alias("n"), (F.col("__n") - F.col(f"v{i}")).alias("nulls")))
    return one.select(F.inline(F.array(*rows)))


def parse_mail(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Messages with ``sender, subject, message_id, reply_to, thread, body``: headers end at the first empty line; a thread goes by the subject without reply marks."""
    parts = messages.withColumn("__text", F.regexp_replace(raw, "\r\n", "\n")).withColumn("__at", F.locate("\n\n", F.col("__text")))
    head = F.regexp_replace(F.when(F.col("__at") > 0, F.substring(F.col("__text"), F.lit(1), F.col("__at"))).otherwise(F.col("__text")), r"\n[ \t]+", " ")
    field = lambda name: F.nullif(F.trim(F.regexp_extract("__head", rf"(?im)^{name}:[ \t]*(.*)$", 1)), F.lit(""))
    out = parts.withColumn("__head", head).withColumns({"sender": field("From"), "subject": field("Subject"), "message_id": field("Message-ID"), "reply_to": field("In-Reply-To")})
    body = F.when(F.col("__at") > 0, F.substring(F.col("__text"), F.col("__at") + 2, F.length("__text"))).otherwise("")
    thread = F.trim(F.lower(F.regexp_replace("subject", r"(?i)^(\s*(re|fw|fwd|aw)\s*:)+", "")))
    return out.withColumns({"thread": thread, "body": body}).drop("__text", "__at", "__head")


def mail_threads(mail: DataFrame) -> DataFrame:
    """``thread, n, n_senders, n_replies`` of parsed messages."""
    return mail.groupBy("thread").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sender").alias("n_senders"), F.count("reply_to").alias("n_replies"))


def value_sources(values: DataFrame) -> DataFrame:
    """``entity, property, n_values, n_sources, first_source, last_source`` over tracked values (entity, property, value, source, at)."""
    return values.groupBy("entity", "property").agg(
        F.count_distinct("value").alias("n_values"), F.count_distinct("source").alias("n_sources"),
        F.min(F.struct("at", "source"))["source"].alias("first_source"), F.max(F.struct("at", "source"))["source"].alias("last_source"),
    )


def guides(traced: DataFrame) -> DataFrame:
    """``entity, property, step, action``: what to look into where sources disagree, most urgent first."""
    n, sources = F.col("n_values").cast("string"), F.col("n_sources").cast("string")
    steps = F.array(
        F.concat(F.lit("Compare the "), n, F.lit(" values of "), F.col("property"), F.lit(" from "), sources, F.lit(" sources")),
        F.concat(F.lit("Check the first source "), F.col("first_source").cast("string")),
        F.when(F.col("last_source") != F.col("first_source"), F.concat(F.lit("Check the last source "), F.col("last_source").cast("string"))),
    )
    found = traced.where("n_values > 1").select("entity", "property", F.posexplode(F.array_compact(steps)).alias("at", "action"))
    return found.select("entity", "property", (F.col("at") + 1).alias("step"), "action")


def translate(values: DataFrame, axioms: list[tuple[str, str, float]]) -> DataFrame:
    """``entity, layer, property, value, axiom``: a value taken through a chain of axioms (name, property it gives, coefficient), a row for each layer; layer 0 is the input."""
    layers = [F.struct(F.lit(0).alias("layer"), F.col("property"), F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("axiom"))]
    factor = 1.0
    for i, (name, gives, by) in enumerate(axioms, 1):
        factor *= by
        layers.append(F.struct(F.lit(i).alias("layer"), F.lit(gives).alias("property"), (F.col("value").cast("double") * factor).alias("value"), F.lit(name).alias("axiom")))
    return values.select("entity", F.inline(F.array(*layers)))


def causal_edges(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edges (src, dst, type) under the stored name of their type, where both ends are decisions (id); edges of unknown types are left out."""
    names = F.create_map(*(F.lit(x) for pair in CAUSAL_TYPES.items() for x in pair))
    named = edges.withColumn("type", F.element_at(names, F.upper(F.trim("type")))).where("type IS NOT NULL")
    for side in ("src", "dst"):
        named = named.join(decisions.select(F.col("id").alias(side)), side, "left_semi")
    return named


def gate(a_type: Column, a_name: Column, b_type: Column, b_name: Column, least_ratio: float = 0.3, shared_word: bool = False) -> Column:
    """Why a pair isn't worth scoring: ``type``, ``length`` or ``words``; null if it is. Pairs without a name on one side pass the gates on names."""
    a, b = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (a_name, b_name))
    words = lambda c: F.filter(F.split(c, r"[\s_-]+"), lambda w: F.length(w) > 2)
    named = (a != "") & (b != "")
    short = F.least(F.length(a), F.length(b)) < least_ratio * F.greatest(F.length(a), F.length(b))
    reasons = [F.when(a_type != b_type, "type"), F.when(named & short, "length")]
    if shared_word:
        reasons.append(F.when(named & (F.size(words(a)) > 0) & (F.size(words(b)) > 0) & ~F.arrays_overlap(words(a), words(b)), "words"))
    return F.coalesce(*reasons)
