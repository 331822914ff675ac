"""PII surrogates: every detected entity gets a keyed replacement of its own type, gender, script and format.

The replacement of an entity is a function of a secret key and the entity's canonical form, so all mentions in all documents
agree, however they are written. Of a person the given name and the surname are entities of their own, so all bearers of a
surname keep a common one. A table of the distinct entities is checked for collisions: where two entities would share a
replacement, or one would be a real entity of the corpus, all but one get a further attempt; entities that still collide after
the last attempt get a replacement that tells their kind and 32 keyed digits, so the work always ends. The key is read by a
scalar subquery and is in no plan. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import Scratch, large, salted_join, spare, stored

# Titles by the gender they tell, Latin and Cyrillic; the last ones tell none.
MALE = ("Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "господин", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа", "г-жа")

NEUTRAL = ("Dr", "Prof", "Mx", "доктор", "профессор")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Titles in capitals as well, where that is no common word or unit.
_TITLE = "(?:" + "|".join((*MALE, *FEMALE, *NEUTRAL, "MR", "MRS", "DR", "PROF", "HERR", "FRAU")) + ")"
_BLANK = r"[ \xa0\t]"
_WORD = r"(?:\p{Lu}[\p{L}\p{M}'’-]+|\p{Lu}(?:\.\p{Lu})*+(?:\.|(?![\p{L}\p{N}])))"
_PARTICLE = rf"(?:(?:van|von|vom|de|der|den|del|della|di|da|dos|du|la|le|bin|al|ter|zu){_BLANK}+)*+"
#: Capitalised words that begin a sentence, and titles: they end a run of names.
_OPENERS = r"(?!(?:The|Then|But|And|He|She|It|They|We|You|I|In|On|At|When|After|Before|This|That|There|If|As|So|Or|For|Of|To|A|An|His|Her)(?![\p{L}\p{N}.'’-]))" + rf"(?!{_TITLE}\.?{_BLANK})"
_NAMES = rf"{_PARTICLE}{_WORD}(?:{_BLANK}+{_PARTICLE}{_OPENERS}{_WORD})*+"
_GROUP = "[0-9a-fA-F]{1,4}"
#: Kinds in order of precedence at one place, and their patterns (after a boundary on the left).
KINDS = {
    "person": rf"(?:{_TITLE}\.?{_BLANK}+{_NAMES}|mrs?\.?{_BLANK}+(?:\p{{Ll}}[\p{{L}}\p{{M}}'’-]+|{_NAMES}))",
    "email": r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])",
    "apikey": r"(?:sk|pk|rk|ghp|gho|ghs|glpat|xox[abps]|AKIA|ASIA|AIza)[-_]?[A-Za-z0-9][-_A-Za-z0-9]{15,}(?![\p{L}\p{N}])",
    "ipv6": rf"(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=[a-fA-F:]*\d)(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?)(?![\p{{L}}\p{{N}}:])",
    "ip": r"(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![\d]|\.\d)",
    "card": r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?![\d\p{L}])",
    "secret": r"[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])",
}
PATTERN = r"(?<!\d\.)(?<![\p{L}\p{N}_@+])(?:" + "|".join(KINDS.values()) + ")"

# Syllables of invented names; endings tell the gender.
_SYLLABLES = {
    "latin": ("ba", "do", "fe", "gi", "ha", "ke", "lo", "mi", "na", "pe", "ro", "sa", "te", "vi", "wo", "za"),
    "cyrillic": ("ба", "до", "фе", "ги", "ха", "ке", "ло", "ми", "на", "пе", "ро", "са", "те", "ви", "жо", "за"),
}
_ENDINGS = {
    ("latin", "male"): ("rd", "n", "rt", "s", "m", "lf", "k", "r"),
    ("latin", "female"): ("na", "lia", "ra", "tta", "sa", "nne", "ria", "la"),
    ("latin", "surname"): ("ner", "son", "ley", "mann", "dez", "tti", "rier", "wick"),
    ("cyrillic", "male"): ("р", "н", "м", "й", "слав", "к", "в", "т"),
    ("cyrillic", "female"): ("на", "лия", "ра", "та", "са", "ня", "рия", "ла"),
    ("cyrillic", "surname"): ("ненко", "чук", "цев", "ский", "ров", "лин", "тько", "рян"),
}


def kind_of(mention: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        found = F.when(mention.rlike("^" + pattern + "$"), F.lit(kind)).otherwise(found)
    return found


def canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one entity share: digits, or lower case."""
    return (
        F.when(kind.isin("phone", "ssn", "card"), F.regexp_replace(mention, r"\D", ""))
        .when(kind == "iban", F.replace(mention, F.lit(" ")))
        .when(kind == "apikey", mention)
        .otherwise(F.lower(mention))
    )


def gender(mention: Column) -> Column:
    """Of a person's mention; a title that tells none gives names of either kind."""
    starts = lambda titles: mention.rlike("(?iu)^(?:" + "|".join(titles) + rf")\.?{_BLANK}")
    return F.when(starts(FEMALE), F.lit("female")).when(starts(MALE), F.lit("male")).otherwise(F.lit("any"))


def _stream(key: Column, *parts: Column) -> Column:
    """128 hexadecimal digits that only the key's holder can foretell (an HMAC-like hash under the key)."""
    inner = F.sha2(F.concat_ws("\x1f", key, *parts), 256)
    return F.sha2(F.concat(key, inner), 512)


def _nibble(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i % 128 + 1).cast("int"), F.lit(1)), 16, 10).cast("int")


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, ((2 * i) % 126 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _recast(text: Column, stream: Column) -> Column:
    """Each digit becomes a digit, each letter a letter of its case and script, everything else stays."""

    def one(c: Column, i: Column) -> Column:
        n = _byte(stream, i)
        pick = lambda letters, size: F.substring(F.lit(letters), (n % size + 1).cast("int"), F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", 26))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26))
            .when(c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), pick("АБВГДЕЖЗИКЛМНОПРСТУФХ", 21))
            .when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфх", 21))
            .when(c.rlike(r"\p{Lu}"), pick("ÀÉÈÊÎÔÛÇÑÄÖÜ", 12))
            .when(c.rlike(r"\p{L}"), pick("àéèêîôûçñäöü", 12))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _digits(mention: Column, stream: Column, skip: Column | int = 0) -> Column:
    """The mention with its n-th digit replaced by the stream's n-th; the first ``skip`` digits stay. Formatting does not matter."""
    chars = F.split(mention, "")
    seen = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.when(s["n"] < skip, c).otherwise((_byte(stream, s["n"]) % 10).cast("string"))).alias("out"), (s["n"] + 1).alias("n"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["n"].alias("n"))
        ),
    )
    return seen["out"]


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn rule, modulo 10."""
    back = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(back, F.lit(0), lambda s, x: s + x) % 10


def _card(mention: Column, stream: Column) -> Column:
    """A card number's last digit keeps the Luhn rule where the original did."""
    made = _digits(mention, stream)
    bare = lambda x: F.regexp_replace(x, r"\D", "")
    body = F.substring(made, F.lit(1), F.length(made) - 1)
    check = ((10 - _luhn(F.concat(bare(body), F.lit("0")))) % 10).cast("string")
    return F.when(_luhn(bare(mention)) == 0, F.concat(body, check)).otherwise(made)


def _name_word(word: Column, role: Column, gender_: Column, stream: Column, attempt: Column) -> Column:
    """A name of the word's script; given names end as the gender's names do; further attempts are longer."""
    script = F.when(word.rlike(r"^\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    told = F.when(gender_ != "any", gender_).when(_nibble(stream, F.lit(1)) % 2 == 0, F.lit("male")).otherwise(F.lit("female"))
    made = F.lit("")
    for s, syllables in _SYLLABLES.items():
        table = F.array(*map(F.lit, syllables))
        body = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: F.element_at(table, _nibble(stream, i + 4) + 1)), "")
        for part in ("male", "female", "surname"):
            ends = F.array(*map(F.lit, _ENDINGS[s, part]))
            fits = (script == s) & (F.when(role == "surname", F.lit("surname")).otherwise(told) == part)
            made = F.when(fits, F.concat(body, F.element_at(ends, _nibble(stream, F.lit(0)) % 8 + 1))).otherwise(made)
    return F.when(word.rlike(r"^\p{Lu}{2,}$"), F.upper(made)).otherwise(F.initcap(made))


def _initials(part: Column, stream: Column) -> Column:
    """Initials moved on in their alphabet by one keyed number, so different ones stay different; others than Latin and Cyrillic ones become the first Latin ones."""

    def moved(alphabet: str) -> Column:
        place = lambda c: (F.instr(F.lit(alphabet), c) + _byte(stream, F.lit(0)) % (len(alphabet) - 1)) % len(alphabet) + 1
        one = lambda c: F.when(c == ".", c).otherwise(F.substring(F.lit(alphabet), place(c).cast("int"), F.lit(1)))
        return F.when(part.rlike(rf"^[{alphabet}.]+$"), F.array_join(F.transform(F.split(part, ""), one), ""))

    return F.coalesce(moved("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), moved("АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ"), F.regexp_replace(part, r"\p{L}", "A"))


def secret_of(spark: SparkSession, key: str) -> Column:
    """The key as a scalar subquery over a local table of one row; a plan names the table's column, never its value."""
    gateway = spark.sparkContext._gateway
    values = gateway.new_array(gateway.jvm.java.lang.Object, 1)
    values[0] = key
    rows = gateway.jvm.java.util.ArrayList()
    rows.add(gateway.jvm.org.apache.spark.sql.RowFactory.create(values))
    schema = spark._jsparkSession.parseDataType(T.StructType([T.StructField("key", T.StringType())]).json())
    return DataFrame(spark._jsparkSession.createDataFrame(rows, schema), spark).scalar()


def with_surrogate(df: DataFrame, key: Column, mention: str) -> DataFrame:
    """``df`` (``kind, canon, gender, attempt``) with ``made``, the replacement of column ``mention``. The key makes two streams, as columns."""
    host = _stream(key, F.lit("domain"), F.lower(F.substring_index(mention, "@", -1)))
    of = F.when(F.col("kind") == "initial", F.lit("")).otherwise(F.col("canon"))
    streams = df.withColumns({"stream": _stream(key, F.col("kind"), of, F.col("gender"), F.col("attempt").cast("string")), "host_stream": host})
    return streams.withColumn("made", surrogate(F.col("kind"), F.col(mention), F.col("gender"), F.col("attempt"), F.col("stream"), F.col("host_stream"))).drop("stream", "host_stream")


def surrogate(kind: Column, mention: Column, gender_: Column, attempt: Column, stream: Column, host_stream: Column) -> Column:
    """The replacement of a mention (of a person: of one of the name's words); after the last attempt a plain one that cannot collide."""
    # Country codes stay, and addresses at one domain stay at one domain; a further attempt makes the local part longer.
    country = F.length(F.regexp_replace(F.regexp_extract(mention, r"^\+(\d{1,3})[ .(-]", 1), r"\D", ""))
    octet = lambda i: (_byte(stream, F.lit(i)) % 254 + 1).cast("string")
    local, domain = F.substring_index(mention, "@", 1), F.substring_index(mention, "@", -1)
    host = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1)
    longer = F.translate(F.substring(stream, F.lit(100), attempt), "0123456789", "ghijklmnop")
    email = F.concat(_recast(local, stream), longer, F.lit("@"), _recast(host, host_stream), F.lit("."), F.substring_index(domain, ".", -1))
    start = F.regexp_extract(mention, "^(?:(?:sk|pk|rk|ghp|gho|ghs|glpat|xox[abps]|AKIA|ASIA|AIza)[-_]?)", 0)
    bare = F.replace(mention, F.lit(" "))
    account = F.concat(F.substring(bare, 1, 2), _recast(F.substr(bare, F.lit(3)), stream))
    account = F.when(F.contains(mention, F.lit(" ")), F.regexp_replace(account, "(.{4})(?=.)", "$1 ")).otherwise(account)
    return (
        F.when(attempt < 0, F.concat(kind, F.lit("-"), F.substring(stream, 1, 32)))
        .when(kind.isin("given", "surname"), _name_word(mention, kind, gender_, stream, attempt))
        .when(kind == "initial", _initials(mention, stream))
        .when(kind == "email", email)
        .when(kind == "phone", _digits(mention, stream, country))
        .when(kind == "ssn", _digits(mention, stream))
        .when(kind == "ip", F.concat_ws(".", *(octet(i) for i in range(4))))
        .when(kind == "card", _card(mention, stream))
        .when(kind == "iban", account)
        .when(kind == "apikey", F.concat(start, _recast(F.substr(mention, F.length(start) + 1), stream)))
        .otherwise(_hex(mention, stream))
    )


def _hex(mention: Column, stream: Column) -> Column:
    """Hexadecimal digits become others of the same case; colons stay."""
    lower = lambda i: F.substring(stream, (i % 128 + 1).cast("int"), F.lit(1))
    digit = lambda c, i: F.when(c == ":", c).when(c.rlike("[A-F]"), F.upper(lower(i))).otherwise(lower(i))
    return F.array_join(F.transform(F.split(mention, ""), digit), "")


def settle(entities: DataFrame, key: Column, tmp: Scratch, most_attempts: int = 16) -> DataFrame:
    """Give each distinct entity (``kind, canon, gender, sample``) the first ``attempt`` at which all replacements differ.

    ``sample`` is one mention. The loop ends when no two entities of a kind share a replacement and none is an entity itself;
    each round hashes only, and moves on the losers (all but the first by canonical form). Whoever still loses after
    ``most_attempts`` rounds, as where a format has fewer forms than there are entities, gets attempt -1.
    """
    now = real = tmp.keep(entities.withColumn("attempt", F.lit(0)), "entities")
    for round_ in range(most_attempts):
        made = with_surrogate(now, key, "sample").withColumn("made", canonical(F.col("kind"), F.col("made")))
        shared = made.groupBy("kind", "made").agg(F.min(F.struct("canon", "gender")).alias("first"), F.count(F.lit(1)).alias("n"))
        taken = real.select(F.col("kind").alias("k"), F.col("canon").alias("c")).distinct()
        shared = shared.join(taken, (F.col("kind") == F.col("k")) & (F.col("made") == F.col("c")), "left").filter((F.col("n") > 1) | F.col("c").isNotNull())
        shared = tmp.keep(shared.select("kind", "made", F.when(F.col("c").isNull(), F.col("first")).alias("first")), "collisions")
        if shared.isEmpty():
            break
        lost = F.col("s.made").isNotNull() & ~F.coalesce(F.struct("m.canon", "m.gender") == F.col("s.first"), F.lit(False))
        after = F.lit(-1) if round_ == most_attempts - 1 else F.col("m.attempt") + 1
        now = tmp.keep(
            made.alias("m")
            .join(shared.alias("s"), (F.col("m.kind") == F.col("s.kind")) & (F.col("m.made") == F.col("s.made")), "left")
            .select("m.kind", "m.canon", "m.gender", "m.sample", F.when(lost, after).otherwise(F.col("m.attempt")).alias("attempt")),
            "entities",
        )
    return now


def pseudonymise(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text_col`` replaced; other columns unchanged, whatever their names.

    Null and entity-free texts stay as they are; repeated rows get equal results; a null id is a value like others; an
    empty table gives an empty table; the time of a very long text grows with its length. ``count_col`` adds the number of
    replaced mentions (a column of that name is replaced). Persons are found after a title only: a run of
    capitalised words, initials and particles in any blanks, or one word after a small ``mr`` or ``mrs``; a word that often begins a sentence
    ends the run. The last word is the surname. Initials are not tied to the names they stand for.
    """
    spark, text = docs.sparkSession, F.col(text_col)
    secret = secret_of(spark, key)
    mentions = F.regexp_extract_all(text, F.lit(PATTERN), 0)
    h, own_id, own_h, made_at = spare(docs, "_h", "_own_id", "_own_h", "_made")
    with Scratch(spark, "pii") as tmp:
        found = tmp.keep(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("x"), F.posexplode(mentions).alias("pos", "mention")), "mentions")
        kinds = found.select("mention").distinct().withColumn("kind", kind_of(F.col("mention")))
        # A mention's parts: a person's words, else itself.
        title = F.when(F.col("kind") == "person", F.regexp_extract("mention", rf"(?iu)^{_TITLE}\.?{_BLANK}+{_PARTICLE}", 0)).otherwise(F.lit(""))
        rest = F.substr(F.col("mention"), F.length("title") + 1)
        words = F.when(F.col("kind") == "person", F.regexp_extract_all(rest, F.lit(rf"[^ \xa0\t]+(?:{_BLANK}+{_PARTICLE})?"), F.lit(0))).otherwise(F.array(rest))
        parts = kinds.withColumn("title", title).select("mention", "title", "kind", F.size(words).alias("n"), F.posexplode(words).alias("at", "piece"))
        gap = F.when(F.col("kind") == "person", F.regexp_extract("piece", rf"^[^ \xa0\t]+(.*)$", 1)).otherwise(F.lit(""))
        parts = parts.withColumn("gap", gap).withColumn("part", F.substr(F.col("piece"), F.lit(1), F.length("piece") - F.length("gap")))
        initial = F.col("part").rlike(r"^\p{Lu}(?:\.\p{Lu})*\.?$")
        role = F.when(F.col("kind") != "person", F.col("kind")).when(initial, F.lit("initial")).when(F.col("at") == F.col("n") - 1, F.lit("surname")).otherwise(F.lit("given"))
        told = F.when(role == "given", gender(F.col("mention"))).otherwise(F.lit(""))
        parts = parts.select("mention", "title", "at", "gap", "part", told.alias("gender"), role.alias("kind"))
        parts = tmp.keep(parts.withColumn("canon", canonical(F.col("kind"), F.col("part"))), "parts")
        # A title that tells no gender leaves it to the other mentions of the name, if these agree.
        told = F.when(F.col("gender") != "any", F.col("gender"))
        agreed = parts.groupBy("kind", "canon").agg(F.min(told).alias("least"), F.max(told).alias("most"))
        agreed = agreed.select("kind", "canon", F.when(F.col("least") == F.col("most"), F.col("least")).alias("agreed"))
        parts = salted_join(parts, agreed, ["kind", "canon"], "mention").withColumn("gender", F.when(F.col("gender") == "any", F.coalesce("agreed", "gender")).otherwise(F.col("gender")))
        parts = tmp.keep(parts.drop("agreed"), "parts")
        distinct = parts.groupBy("kind", "canon", "gender").agg(F.min("part").alias("sample"))
        entities = settle(distinct.filter("kind <> 'initial'"), secret, tmp).unionByName(distinct.filter("kind = 'initial'").withColumn("attempt", F.lit(0)))
        named = salted_join(parts, entities.select("kind", "canon", "gender", "attempt"), ["kind", "canon", "gender"], "mention")
        whole = F.concat("title", F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "made"))), lambda x: x["made"]), ""))
        replaced = tmp.keep(with_surrogate(named, secret, "part").withColumn("made", F.concat("made", "gap")).groupBy("mention", "title").agg(whole.alias("made")).select("mention", "made"), "replaced")
        placed = salted_join(found, replaced, ["mention"], "id")
        maps = placed.groupBy("id", "x").agg(F.sort_array(F.collect_set(F.struct("pos", "made"))).alias("made"))  # repeated rows have the same places
        maps = stored(maps.select(F.col("id").alias(own_id), F.col("x").alias(own_h), F.transform("made", lambda x: x["made"]).alias(made_at)), "pii-places")
    rest = [c for c in docs.columns if c != count_col]
    joined = docs.select(*rest).withColumn(h, F.xxhash64(text)).join(large(maps), F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(h) == F.col(own_h)), "left")
    gaps = F.split(text, PATTERN, -1)
    whole = F.array_join(F.zip_with(gaps, made_at, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    columns = [F.when(F.col(made_at).isNull(), text).otherwise(whole).alias(c) if c == text_col else F.col(c) for c in rest]
    if count_col:
        columns.append(F.when(F.col(made_at).isNull(), F.lit(0)).otherwise(F.size(made_at)).cast("long").alias(count_col))
    return joined.select(*columns)
