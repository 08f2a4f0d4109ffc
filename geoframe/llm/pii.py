"""Personal data: detection, and surrogates in its place, in DataFrame functions only.

Detected: e-mail addresses, telephone numbers (3-3-4 digits, or + and 8 to 15 digits in any
groups), IPv4 addresses, card numbers (four groups of four digits, and three more; other
forms of 13 to 19 digits by their Luhn sum), national ids (ddd-dd-dddd), IBANs, cloud access keys, values
assigned to passwords, secrets, tokens and API keys (to the next quote or white space; a value without a letter or
digit is a placeholder and stays), and names after a title. In a document with such a name, later mentions without
the title are found too: the whole name, the family name, or a given name.

Entities consist of parts, and a part's identity is its type and normal form, so that it is told again in other
spellings: a telephone number's last ten digits, a card's digits; an address's mailbox (in lower case, with its
domain) and its domain; a name's words, the last as family name, the others as given names of the title's gender.
So `Mrs. Jane Miller`, `Jane Miller`, `Mrs. Miller` and `Miller` share their surrogate words, in all documents.
Surrogates come from a keyed hash of the identity:

* digits for digits and letters for letters of the same case and script (of hexadecimal values: hexadecimal ones),
  punctuation, spaces and quotes as they were; a card keeps its first digit and its Luhn remainder; an IP address
  has octets of 1 to 254; mail domains keep their last label;
* names by gender and script, from the lists below and, from the third attempt on, made-up ones, longer and longer.

Collision check: identities whose surrogates are equal, or equal to any identity of the corpus, take the next
attempt of their hash until all differ; of those that meet, the first in order keeps its own. From the fourth attempt
on mailboxes, domains and secrets get more characters, and from the ninth on anything else a name of its kind and a
hash, so an end is reached even where all values of a form are taken. So different entities stay different, and equal
ones equal, over all documents. The check is made on the table of distinct identities alone.

Edge cases: null texts stay null and empty ones empty; texts without entities, of any length, are returned as they
are and never shuffled. Repeated rows are treated alike; ties go to the identity that sorts first. An empty table gives
an empty result. An input column called entities is returned as `entities_in` (by the stage under its own name).
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoframe.llm import common

#: Session setting of the key of the queries and the stage; without it a session draws one, so that nobody can look surrogates up.
KEY = "spark.geoframe.pii.key"

#: Titles by gender, and surrogate names by script and gender.
TITLES_F = "Mrs|Ms|Miss|Madame|Mme|Frau|Señora|Sra|Signora|Senhora|Mevrouw|Госпожа|Κυρία"
TITLES_M = "Mr|Mister|Monsieur|Herr|Señor|Sr|Signor|Senhor|Meneer|Господин|Κύριος"
NAMES = {
    "Latin": {
        "given f": "Ada Alma Berta Carla Clara Diana Edith Elena Flora Greta Helen Ines Irma Julia Laura Lucia Marta Nadia Olga Paula",
        "given m": "Adam Alan Boris Carl Conrad David Edgar Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Ralf",
        "family": "Abel Arden Baker Berger Blanc Castro Dalton Duval Engel Fisher Garcia Gruber Holm Jansen Keller Lopez Martin Moreau Novak Ortega Parker Petit Quinn Rivera Roth Sanders Torres Ulrich Vidal Weber",
        "syllables": "ba be bo da de do fa fe ga ge ka ke la le lo ma me mo na ne no ra re ro sa se ta te va ve", "f": "na", "m": "n",
    },
    "Cyrillic": {
        "given f": "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Юлия", "given m": "Андрей Борис Виктор Егор Иван Марк Олег Пётр Роман Юрий",
        "family": "Белых Гайдар Долгих Живаго Коваль Мельник Рудых Сидор Черных Шевчук", "syllables": "ба бе бо да де до га ка ке ла ле ма ме на не но ра ре са та", "f": "на", "m": "н",
    },
    "Greek": {
        "given f": "Άννα Ελένη Ειρήνη Μαρία Σοφία", "given m": "Ανδρέας Γιώργος Νίκος Πέτρος Χρήστος", "family": "Αλεξίου Γεωργίου Δημητρίου Νικολάου Παππάς",
        "syllables": "βα βε δα δε κα κε λα λε μα με να νε ρα ρε σα τα", "f": "να", "m": "νος",
    },
}

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: A word of a name; after an apostrophe or a hyphen it may have a capital again.
WORD = r"\p{Lu}(?:[\p{Ll}'-]|(?<=['-])\p{Lu}){1,40}+"
#: The forms, in order of precedence. Each start is guarded, so that long runs are passed in one go.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{0,40}?(?:(?i)password|passwd|secret|token|api[_-]?key)(?:[_-][A-Za-z0-9_-]{0,40}+|\d{1,4}+|(?<=[a-z])[A-Z][A-Za-z0-9_-]{0,40}+)?[\"']?\s{0,2}[=:]\s{0,2}[\"']?(?=[^\s\"']{0,200}[A-Za-z0-9])[^\s\"']{7,}[^\s\"'.,;:!?)}\]][\"']?",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national_id": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d{4}(?:[ -]?\d{4}){3}(?!\d|[ -]\d{3}(?!\d))",
    "long_card": r"(?<![\d-])(?:\d{4}(?:[ -]?\d{4}){3}[ -]\d{3}|[2-6]\d{12,18}+|3\d{3}[ -]\d{6}[ -]\d{4,5})(?!\d)",
    "phone": r"(?:(?<![\w+])\+\d{1,3}[ .-]?|(?<![\w+.-]))(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+(?:1\d{10}|[1-9](?:[ ./-]?\(?\d\)?){7,14}+)(?!\d)",
    "name": rf"(?<![\p{{L}}])(?:{TITLES_F}|{TITLES_M})\.? {WORD}(?: {WORD}){{0,2}}",
}
PATTERN = "|".join(FORMS.values())
#: What every form but a name holds, and what every name starts with.
HINT = rf"[0-9@]|[=:]\s*[\"']?[^\s\"']{{8}}|(?:{TITLES_F}|{TITLES_M})\.? \p{{Lu}}"


#: The kind of what has a form by chance; it stays.
NONE = "none"


TITLE = rf"^(?:{TITLES_F}|{TITLES_M})\.? "
#: From these attempts on surrogates get more characters, or the name of their kind and a hash.
LONGER, LAST = 3, 8


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, form in reversed(FORMS.items()):
        out = F.when(entity.rlike(rf"^(?:{form})$"), F.lit(name)).otherwise(out)
    # without groups of four, numbers of other lengths than 16 are cards by their Luhn sum only
    return F.when(out == "long_card", F.when((luhn(digits(entity)) == 0) | entity.rlike(r"^\d{4}(?:[ -]?\d{4}){3}[ -]"), F.lit("card")).otherwise(F.lit(NONE))).otherwise(F.coalesce(out, F.lit("secret")))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


VALUE = r"[=:]\s*[\"']?([^\s\"']+)"


def gender(entity: Column) -> Column:
    return F.when(entity.rlike(rf"^(?:{TITLES_F})\.? "), F.lit("f")).otherwise(F.lit("m"))


def words_of(entity: Column) -> Column:
    """The words of a name without its title."""
    return F.split(F.regexp_replace(entity, TITLE, ""), " ")


def bare(word: Column) -> Column:
    return F.regexp_replace(word, "('s|')$", "")


def parts_of(kind: Column, entity: Column, mark: Column) -> Column:
    """The parts of an entity: (kind, identity). mark: of a mention, the roles of its words; else empty."""
    words = words_of(entity)
    roles = F.when(mark == "", F.transform(words, lambda w, i: F.when(i == F.size(words) - 1, F.lit("family")).otherwise(F.concat(F.lit("given "), gender(entity))))).otherwise(F.split(mark, ","))
    part = lambda k, i: F.struct(k.alias("kind"), i.alias("identity"))
    address = F.lower(entity)
    other = (F.when(kind == "phone", F.right(digits(entity), F.lit(10))).when(kind.isin("card", "national_id"), digits(entity))
             .when(kind == "iban", F.regexp_replace(entity, " ", "")).when(kind == "secret", F.regexp_extract(entity, VALUE, 1)).otherwise(entity))
    return (F.when(kind == "name", F.zip_with(roles, words, lambda r, w: part(r, F.lower(bare(w)))))
            .when(kind == "email", F.array(part(F.lit("mailbox"), address), part(F.lit("domain"), F.regexp_extract(address, "@(.*)$", 1))))
            .when(kind == NONE, F.array().cast("array<struct<kind:string,identity:string>>")).otherwise(F.array(part(kind, other))))


def stream(seed: Column, length: Column) -> Column:
    """Numbers 0 to 65535 from a keyed hash of seed, at least `length` of them, and 16."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(length / 16).cast("int")), lambda b: F.sha2(F.concat_ws("\x1f", seed, b.cast("string")), 256))
    return F.transform(F.regexp_extract_all(F.array_join(blocks, ""), F.lit("([0-9a-f]{4})"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("int"))


def like(text: Column, numbers: Column) -> Column:
    """Text with other digits and letters of the same class, by the numbers; what has hexadecimal letters only keeps to them."""
    wide = F.when(text.rlike("^[0-9a-fA-F]+$"), F.lit(6)).otherwise(F.lit(26))
    letter = lambda first, n, at: F.char(F.lit(ord(first)) + F.element_at(numbers, at + 1) % n)
    return F.array_join(F.transform(F.split(text, ""), lambda c, i:
        F.when(c.rlike("[0-9]"), letter("0", 10, i)).when(c.rlike("[a-z]"), letter("a", wide, i)).when(c.rlike("[A-Z]"), letter("A", wide, i)).when(c.rlike(r"\p{L}"), letter("a", wide, i)).otherwise(c)), "")


def pick(names: str, number: Column) -> Column:
    names = names.split()
    return F.element_at(F.array(*map(F.lit, names)), number % len(names) + 1)


def luhn(number: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: (lambda d: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10


def surrogate(key: str) -> Column:
    """The normal form of the surrogate of (kind, identity, attempt)."""
    kind, own, attempt = F.col("kind"), F.col("identity"), F.col("attempt")
    seed = F.concat_ws("\x1f", F.lit(key), kind, own, attempt.cast("string"))
    n = stream(seed, F.length(own))
    at = lambda i: F.element_at(n, i)
    # the last digit makes up for the change of the Luhn sum
    body = F.concat(F.substring(own, 1, 1), F.expr("substring(_like, 2, length(identity) - 2)"))
    card = F.concat(body, ((luhn(own) - luhn(F.concat(body, F.lit("0"))) + 10) % 10).cast("string"))
    more = F.when(attempt >= LONGER, F.substring(F.sha2(seed, 256), 1, 12)).otherwise(F.lit(""))
    def named(script: dict) -> Column:
        made = F.array_join(F.transform(F.sequence(F.lit(1), F.least(F.lit(12), 2 + F.floor(attempt / 2).cast("int"))), lambda i: pick(script["syllables"], F.element_at(n, i + 2))), "")
        made = F.concat(made, F.when(kind == "given f", F.lit(script["f"])).when(kind == "given m", F.lit(script["m"])).otherwise(F.lit("")))
        listed = F.when(kind == "given f", pick(script["given f"], at(1))).when(kind == "given m", pick(script["given m"], at(1))).otherwise(pick(script["family"], at(1)))
        return F.lower(F.when(attempt >= 2, made).otherwise(listed))

    name = F.when(own.rlike(r"\p{IsCyrillic}"), named(NAMES["Cyrillic"])).when(own.rlike(r"\p{IsGreek}"), named(NAMES["Greek"])).otherwise(named(NAMES["Latin"]))
    return (F.when(kind == "mailbox", F.concat(F.regexp_extract("_like", "^(.*)@", 1), more, F.lit("@"), F.regexp_extract(own, "@(.*)$", 1)))
            .when(kind == "domain", F.concat(F.regexp_extract("_like", r"^(.*)\.[^.]*$", 1), more, F.regexp_extract(own, r"(\.[^.]*)$", 1)))
            .when(kind.isin("given f", "given m", "family"), name)
            .when(kind == "secret", F.concat(F.col("_like"), more))
            .when(attempt >= LAST, F.concat(kind, F.lit("-"), F.substring(F.sha2(seed, 256), 1, 16)))
            .when(kind == "card", card)
            .when(kind == "ip", F.concat_ws(".", *[(at(i) % 254 + 1).cast("string") for i in range(1, 5)]))
            .when(kind == "access_key", F.concat(F.substring(own, 1, 4), F.expr("substring(_like, 5, length(identity))")))
            .when(kind == "iban", F.concat(F.substring(own, 1, 2), F.expr("substring(_like, 3, length(identity))")))
            .otherwise(F.col("_like")))


def with_surrogates(identities: DataFrame, key: str) -> DataFrame:
    """identities (kind, identity) with their surrogates, all different from each other and from all identities of their kind."""
    known = identities.select("kind", F.col("identity").alias("surrogate"), F.lit(True).alias("_real"))
    now, before = identities.withColumn("attempt", F.lit(0)), None
    seed = F.concat_ws("\x1f", F.lit(key), F.lit("like"), F.col("kind"), F.col("identity"), F.col("attempt").cast("string"))
    while True:
        tried = now.withColumn("_like", like(F.col("identity"), stream(seed, F.length("identity")))).withColumn("surrogate", surrogate(key)).drop("_like")
        first = tried.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "identity")).alias("_first"))
        tried = tried.join(first, ["kind", "surrogate"]).join(known, ["kind", "surrogate"], "left")
        tried = tried.withColumn("_again", (F.col("_first.identity") != F.col("identity")) | F.col("_real").isNotNull()).drop("_real", "_first")
        tried = common.written(tried, "surrogates")
        if before is not None:
            common.discard(before)
        if tried.where("_again").isEmpty():
            return tried.select("kind", "identity", "surrogate")
        now, before = tried.select("kind", "identity", (F.col("attempt") + F.col("_again").cast("int")).alias("attempt")), tried


def in_form() -> Column:
    """The surrogates of an entity's parts (_s), in the spelling of the entity."""
    kind, entity, new = F.col("kind"), F.col("entity"), F.col("_s")[0]
    shape = F.split(entity, "")
    places = lambda mark: F.transform(F.sequence(F.lit(1), F.length(entity)), lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), mark, "")))
    # the k-th digit (letter) from the end of the entity is the k-th from the end of the surrogate; what stands before stays
    def fill(mark: str) -> Column:
        total = F.length(F.regexp_replace(entity, mark, ""))
        spare = total - F.length(new)
        return F.array_join(F.zip_with(shape, places(mark), lambda c, k: F.when(c.rlike(mark) | (k <= spare), c).otherwise(F.substring(new, k - spare, F.lit(1)))), "")

    names = F.array_join(F.zip_with(words_of(entity), F.col("_s"), lambda w, s: F.concat(F.initcap(s), F.regexp_extract(w, "('s|')$", 1))), " ")
    address = F.concat(F.regexp_extract(new, "^(.*)@", 1), F.lit("@"), F.col("_s")[1])
    return (F.when(kind == "name", F.concat(F.regexp_extract(entity, f"({TITLE})", 1), names))
            .when(kind == "email", F.when(entity == F.upper(entity), F.upper(address)).otherwise(address))
            .when(kind == "secret", F.concat(F.regexp_extract(entity, r"^([^=:]*[=:]\s*[\"']?)", 1), new,
                                             F.when(entity.rlike("[\"']$"), F.right(entity, F.lit(1))).otherwise(F.lit(""))))
            .when(new.startswith(F.concat(kind, F.lit("-"))), new)
            .when(kind.isin("phone", "card", "national_id"), fill("[^0-9]")).when(kind == "iban", fill(" ")).otherwise(new))


def marked(found: Column) -> tuple[Column, Column]:
    """Of the entities of a text: the names among them without titles (struct of gender and words), and the mentions to look for."""
    names = F.transform(F.filter(found, lambda e: e.rlike(rf"^(?:{FORMS['name']})$")), lambda e: F.struct(gender(e).alias("g"), F.transform(words_of(e), bare).alias("w")))
    full = F.transform(F.filter("_names", lambda n: F.size(n["w"]) > 1), lambda n: F.array_join(n["w"], " "))
    single = F.filter(F.flatten(F.transform("_names", lambda n: n["w"])), lambda w: F.length(w) > 2)
    return names, F.array_distinct(F.concat(full, single))


def role(entity: Column) -> Column:
    """The roles of a mention's words, as the names of its text have them."""
    last = F.transform("_names", lambda n: F.element_at(n["w"], -1))
    owner = lambda w: F.filter("_names", lambda n: F.array_contains(n["w"], w))[0]["g"]
    words = F.split(entity, " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((i == F.size(words) - 1) & F.array_contains(last, w), F.lit("family")).otherwise(F.concat(F.lit("given "), owner(w)))), ",")


def replace(docs: DataFrame, text: str = "text", *, key: str) -> DataFrame:
    """docs with surrogates in the text, and entities: array of {kind, surrogate} in text order. key: secret; who has it can tell surrogates."""
    docs, moved = common.aside(docs, "entities")
    text = {c: free for free, c in moved.items()}.get(text, text)
    own, size, whole = docs.columns, common.size_in_bytes(docs), F.col(text)
    columns = [F.col(f"`{c}`") for c in own]
    found = F.when(whole.rlike(HINT), F.regexp_extract_all(whole, F.lit(PATTERN), F.lit(0)))
    rid = F.xxhash64(*[c for c in ("doc_id", text) if c in own])
    seen = docs.select(*columns, F.coalesce(found, F.array().cast("array<string>")).alias("_found"))
    names, mentions = marked(F.col("_found"))
    hits = seen.where(F.size("_found") > 0).select(rid.alias("_rid"), *columns, "_found", names.alias("_names"))
    hits = hits.select("*", mentions.alias("_mentions"))
    again = F.when(F.size("_mentions") > 0, F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), F.array_join("_mentions", "|"), F.lit(r")(?!\p{L})")))
    hits = hits.select("*", again.alias("_pattern"))
    every = F.when(F.col("_pattern").isNull(), F.col("_found")).otherwise(F.regexp_extract_all(whole, F.col("_pattern"), F.lit(0)))
    entities = F.transform(every, lambda e: F.struct(e.alias("entity"), F.when(F.array_contains("_mentions", e), role(e)).otherwise(F.lit("")).alias("mark")))
    hits = common.written(common.few_files(hits.select("_rid", *columns, "_pattern", entities.alias("_found")), size), "entities")

    rows = hits.select("_rid", F.posexplode("_found").alias("_at", "_e")).select("_rid", "_at", "_e.entity", "_e.mark")
    forms = rows.groupBy("entity", "mark").agg(F.count("*").alias("n")).withColumn("kind", F.when(F.col("mark") != "", F.lit("name")).otherwise(kind_of(F.col("entity"))))
    forms = common.written(common.few_files(forms.withColumn("_parts", parts_of(F.col("kind"), F.col("entity"), F.col("mark"))), size // 8), "forms")
    parts = forms.select("entity", "mark", F.posexplode("_parts").alias("_k", "_p")).select("entity", "mark", "_k", "_p.kind", "_p.identity")
    named = with_surrogates(parts.select("kind", "identity").distinct(), key)
    spelt = parts.join(named, ["kind", "identity"]).groupBy("entity", "mark").agg(F.sort_array(F.collect_list(F.struct("_k", "surrogate"))).alias("_s"))
    spelt = spelt.select("entity", "mark", F.transform("_s", lambda x: x["surrogate"]).alias("_s"))
    table = forms.join(spelt, ["entity", "mark"], "left").select("entity", "mark", "n", "kind", F.when(F.col("kind") == NONE, F.col("entity")).otherwise(in_form()).alias("surrogate"))
    table = common.written(common.few_files(table, size // 8), "replacements")
    told = common.with_lookup(rows, table, ["entity", "mark"], "n", F.struct("_rid", "_at"))
    # repeated rows share a _rid and have the same entities: a set holds each place once
    told = told.groupBy("_rid").agg(F.sort_array(F.collect_set(F.struct("_at", "kind", "surrogate"))).alias("_told"))
    between = F.when(F.col("_pattern").isNull(), F.split(whole, F.lit(PATTERN), -1)).otherwise(F.split(whole, F.col("_pattern"), -1))
    new = F.transform("_told", lambda x: x["surrogate"])
    joined = F.array_join(F.flatten(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    entities = F.transform(F.filter("_told", lambda x: x["kind"] != NONE), lambda x: F.struct(x["kind"].alias("kind"), x["surrogate"].alias("surrogate")))
    changed = hits.join(told, "_rid").select(*[joined.alias(text) if c == text else F.col(f"`{c}`") for c in own], entities.alias("entities"))
    same = seen.where(F.size("_found") == 0).select(*columns, F.array().cast("array<struct<kind:string,surrogate:string>>").alias("entities"))
    return changed.unionByName(same)


def secret(spark: SparkSession) -> str:
    """The key of this session: as set, or drawn once."""
    found = spark.conf.get(KEY, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY, found)
    return found


def op10_pii_surrogates(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace(docs, key=secret(spark)).select("doc_id", "text", F.size("entities").alias("n_entities"), F.transform("entities", lambda x: x["kind"]).alias("kinds"))


def stage(spark, docs, sf_dir):
    """Documents with surrogates for personal data; n_chars follows the text."""
    columns = docs.columns
    docs, moved = common.aside(docs, "entities")
    found = replace(docs, key=secret(spark))
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.when(F.size("entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return common.restored(found, moved, columns)
