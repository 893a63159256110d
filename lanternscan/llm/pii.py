"""PII: keyed surrogates for detected entities, with DataFrame functions only.

One regular expression finds entities (e-mail addresses, phone and card numbers, IP addresses of both versions, identity and
account numbers, credentials behind a key word or with a known prefix, titled names; names without a title are not found). A
credential reaches to its closing quote or, without quotes, to the next white space. Distinct surfaces are reduced to parts with a
normal form (national digits of a phone number, lower-case mailbox, given name, surname ...), so that every way to write an
entity, in any document, gets the same surrogate: a person keeps one name under any title, a phone number one number with and
without +1. A part's surrogate is derived from a keyed hash: digits for digits, letters for letters of the same case, valid
check digits for cards and IBANs, the country code of a phone number, a name of the same script and of the gender that the given
name or else its titles tell. Surrogates of a type that meet, or that equal a real entity, are derived again with the next
attempt until all differ, and grow longer after a few attempts, so that no space is ever full: equal entities stay equal and
different ones different.

The key is the caller's secret: who has it can compute the table again. Texts are cut at the entities and joined again with the
surrogates in the surface's own format. Null texts stay null, empty texts and texts without entities stay as they are. Repeats in
the patterns are possessive or bounded, so that very long texts of any shape are matched in linear time and constant stack. Rows
that repeat a doc_id are treated by their text; repeated rows get equal results. All columns of the documents are kept,
whatever their names.
"""

from __future__ import annotations

import secrets
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, split_likely, table

#: The session setting with the key of the registered query and of the pipeline.
KEY_SETTING = "spark.lanternscan.surrogate.key"
#: From this attempt on surrogates grow by two characters an attempt.
GROW_AFTER = 4

# Words that name a credential, and how the tokens of well-known services begin.
SECRET_WORDS = "password|passwd|passphrase|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key|secret[_-]?key|auth[_-]?key"
SECRET_BEFORE = "access|auth|client|api|refresh|bearer|private|secret|session|user|admin|root|db"
TOKEN_PREFIXES = [
    "gh[opsur]_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "pk_live_", "rk_live_", "sk-ant-", "sk-proj-", "xox[abprs]-", "AIza", "ya29\\.", "npm_", "pypi-", "shpat_", "dop_v1_", "hf_",
]
#: A mark that ends a sentence or closes a bracket belongs to a bare value only if more of it follows.
_MARK, _PLAIN = r"[.,;:!?)\]}]", r"[^\s\"'`.,;:!?)\]}]"
BARE = rf"(?=[^\s\"'`]{{6}}){_PLAIN}++(?:{_MARK}++{_PLAIN}++){{0,100}}+(?:{_MARK}++{_PLAIN}[^\s\"'`]*+)?+"
QUOTED = r"\"[^\"\r\n]{6,}+\"|'[^'\r\n]{6,}+'|`[^`\r\n]{6,}+`"
SECRET_NAME = rf"(?:[A-Za-z0-9]{{1,32}}+[_-]){{0,4}}(?i:(?:{SECRET_BEFORE})?[_-]?(?:{SECRET_WORDS})(?:[_-](?:key|token|value|id|secret)){{0,3}})"
#: What stands before a credential: its name and a sign, or the name of a scheme.
SECRET_HEAD = rf"(?:{SECRET_NAME}[\"'`]?\s{{0,4}}(?:=>|:=|[=:])\s{{0,4}}(?:(?i:bearer|basic)\s)?|(?i:bearer|basic)\s(?=[A-Za-z0-9_.~+/=-]{{16}}))"

# Entity types with their patterns, in order of preference; titles; given names by gender and script; syllables.
PATTERNS = [
    ("email", r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"),
    ("secret", rf"{SECRET_HEAD}(?:{QUOTED}|{BARE})"),
    ("prefixed", rf"(?:{'|'.join(TOKEN_PREFIXES)})[A-Za-z0-9_-]{{15,}}+(?:\.[A-Za-z0-9_-]++){{0,8}}+"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)?+"),
    ("aws", r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("card", r"[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"),
    ("ipv6", r"(?=[0-9A-Fa-f:]{0,40}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![A-Za-z0-9:])"),
    ("ip", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("phone", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
]
TITLES = {
    "m": ["Mr", "Herr", "Señor", "Sr", "Don", "Monsieur", "г-н", "господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Doña", "Madame", "Mme", "г-жа", "госпожа"],
    "u": ["Dr", "Prof"],
}
GIVEN = {
    "m": ["Adam", "Albert", "Anton", "Bruno", "Carl", "Daniel", "David", "Edgar", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jakob", "Leon", "Lucas", "Marco", "Martin", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"],
    "f": ["Ada", "Alice", "Anna", "Beatrice", "Clara", "Diana", "Elena", "Emma", "Eva", "Flora", "Greta", "Helena", "Ida", "Julia", "Laura", "Lucia", "Maria", "Nina", "Olivia", "Paula", "Rosa", "Sara", "Teresa", "Vera"],
    "m_cyr": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Максим", "Олег", "Павел", "Роман", "Сергей"],
    "f_cyr": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Лариса", "Мария", "Нина", "Ольга", "Софья", "Юлия"],
}
SYLLABLES = {
    "lat": ["bar", "ben", "bor", "dal", "den", "dor", "fal", "fen", "gar", "hal", "kam", "kel", "lin", "lor", "mar", "mel", "nor", "per", "ral", "sel", "tam", "ten", "val", "wen"],
    "cyr": ["бар", "бел", "вол", "гор", "дан", "жар", "зим", "кар", "лес", "мар", "нов", "пет", "рож", "сел", "тар", "хол"],
}
# Country calling codes of one and two digits; all others have three.
CALLING_CODE = "1|7|2[07]|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"

#: One word of a name; with what follows a hyphen, an apostrophe or nothing, if it begins with a capital, or a hyphen.
WORD = r"\p{Lu}(?=[\p{Ll}'’-])\p{Ll}*+(?:-\p{Lu}?\p{Ll}++|['’]?\p{Lu}\p{Ll}++){0,6}+"
NAME = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + rf")\.? {WORD}(?: {WORD})?"
BEFORE = r"(?<![\p{L}\p{N}._%+-])"
ENTITY = BEFORE + "(?:" + "|".join(p for _, p in PATTERNS) + f"|{NAME})"
#: Characters without which no entity occurs.
HINT = "[0-9@=:]|(?i:bearer|basic)\\s|eyJ|" + "|".join(TOKEN_PREFIXES) + "|" + "|".join(f"{t}[. ]" for ts in TITLES.values() for t in ts)
HEX = "0123456789abcdef"


def only(c: Column, kind: str) -> Column:
    return F.regexp_replace(c, f"[^{kind}]", "")


def entity_type(surface: Column) -> Column:
    out = None
    for name, pattern in PATTERNS:
        hit = surface.rlike(f"^(?:{pattern})$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("name")


def entity_parts(kind: Column, surface: Column) -> Column:
    """array<struct<slot, type, norm, gender>> of a surface; a given name comes with the gender that its title tells."""

    def part(slot, t, norm, gender=None):
        return F.struct(F.lit(slot).alias("slot"), (F.lit(t) if isinstance(t, str) else t).alias("type"), norm.alias("norm"), (F.lit(None).cast("string") if gender is None else gender).alias("gender"))

    low = F.lower(surface)
    name = F.regexp_replace(surface, r"^\S+ ", "")
    last = F.lower(F.element_at(F.split(name, " "), -1))
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "_cyr").otherwise("_lat")
    return (
        F.when(kind == "email", F.array(part("v", "email", F.substring_index(low, "@", 1)), part("d", "domain", F.substring_index(low, "@", -1))))
        .when(kind == "secret", F.array(part("v", secret_kind(secret_value(surface)), secret_value(surface))))
        .when(kind == "phone", F.array(part("v", kind, phone_norm(surface))))
        .when(kind.isin("card", "ssn"), F.array(part("v", kind, only(surface, "0-9"))))
        .when(kind == "ipv6", F.array(part("v", kind, low)))
        .when(kind == "name", F.when(
            name.contains(" "),
            F.array(part("g", F.concat(F.lit("given"), script), F.lower(F.substring_index(name, " ", 1)), title_gender(surface)), part("v", F.concat(F.lit("last"), script), last)),
        ).otherwise(F.array(part("v", F.concat(F.lit("last"), script), last))))
        .otherwise(F.array(part("v", kind, F.regexp_replace(surface, " ", ""))))
    )


def secret_head(surface: Column) -> Column:
    """The name of a credential with what stands before the value, an opening quote included."""
    return F.regexp_extract(surface, rf"^({SECRET_HEAD}[\"'`]?)", 1)


def closing_quote(surface: Column) -> Column:
    return F.when(secret_head(surface).rlike("[\"'`]$") & surface.rlike("[\"'`]$"), F.substring(surface, -1, 1)).otherwise(F.lit(""))


def secret_value(surface: Column) -> Column:
    at = F.length(secret_head(surface))
    return F.substr(surface, at + 1, F.length(surface) - at - F.length(closing_quote(surface)))


def secret_kind(value: Column) -> Column:
    """The type of a credential's value: the same with a key word before it and without."""
    out = F.when(F.lit(False), "")
    for name, pattern in PATTERNS:
        if name in ("prefixed", "jwt", "aws"):
            out = out.when(value.rlike(f"^(?:{pattern})$"), name)
    return out.otherwise("secret")


def calling_code(surface: Column) -> Column:
    """The digits of the country code of a phone number that begins with a plus sign, else nothing."""
    return F.regexp_extract(F.concat(F.substring(surface, 1, 1), only(surface, "0-9")), rf"^\+({CALLING_CODE})", 1)


def phone_norm(surface: Column) -> Column:
    """``code|digits``; numbers without a code are those of code 1."""
    code, digits = calling_code(surface), only(surface, "0-9")
    return F.concat(F.when(code == "", "1").otherwise(code), F.lit("|"), F.substr(digits, (F.length(code) + 1).cast("int")))


def title_gender(surface: Column) -> Column:
    title = F.regexp_extract(surface, r"^([^. ]+)", 1)
    return F.when(title.isin(TITLES["f"]), "f").when(title.isin(TITLES["m"]), "m")


def name_gender(norm: Column, n_f: Column, n_m: Column) -> Column:
    """Gender of a given name: a known name's own, else that of most of its titles, else by its ending."""
    known = {g: [x.lower() for k in (g, f"{g}_cyr") for x in GIVEN[k]] for g in ("f", "m")}
    return (
        F.when(norm.isin(known["f"]), "f").when(norm.isin(known["m"]), "m").when(n_f > n_m, "f").when(n_m > n_f, "m")
        .when(norm.rlike("[aаяé]$"), "f").otherwise("m")
    )


def hash_stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 keyed hexadecimal characters."""
    seed = lambda n: F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(n)), kind, attempt.cast("string"), norm), 256)
    return F.concat(seed(0), seed(1))


def byte_of(stream: Column, i: int) -> Column:
    return F.conv(F.substring(stream, 2 * i + 1, 2), 16, 10).cast("int")


def number_of(stream: Column, i: int) -> Column:
    return F.conv(F.substring(stream, 4 * i + 1, 4), 16, 10).cast("int")


def pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))


def shaped(value: Column, stream: Column, hexadecimal: bool = False) -> Column:
    """Digits for digits and letters for letters of the same case, whatever the length; other characters stay. A value without any
    digit or letter becomes hash characters, as nothing of it would change."""
    alphabet = "abcdefabcdefabcd" if hexadecimal else "abcdefghijkmnprs"

    def drawn(piece: Column, s: Column) -> Column:
        at = lambda i: F.substr(s, (i + 1).cast("int"), F.lit(1))
        letter = lambda i: F.translate(at(i), HEX, alphabet)
        return F.array_join(
            F.transform(
                F.split(piece, ""),
                lambda c, i: F.when(c.rlike(r"\p{N}"), F.translate(at(i), "abcdef", "012345"))
                .when(c.rlike(r"\p{Lu}"), F.upper(letter(i)))
                .when(c.rlike(r"\p{L}"), letter(i))
                .otherwise(c),
            ),
            "",
        )

    # The stream, whose hash reads the whole value, is computed once a value, not once a character; pieces are as long as the stream.
    pieces = F.regexp_extract_all(value, F.lit("(?s).{1,128}"), F.lit(0))
    each = F.element_at(F.transform(F.array(stream), lambda s: F.array_join(F.transform(pieces, lambda p: drawn(p, s)), "")), 1)
    size = F.length(value)
    plain = F.substr(F.repeat(F.translate(stream, HEX, alphabet), (size / 128 + 1).cast("int")), F.lit(1), size)
    return F.when(value.rlike(r"[\p{N}\p{L}]"), each).otherwise(plain)


def luhn(body: Column) -> Column:
    """The digits of a card number without the last, with a valid last digit."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(
        F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, doubled(c.cast("int"))).otherwise(c.cast("int"))),
        F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)),
    )
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def iban(country: Column, account: Column) -> Column:
    """Country and account with valid check digits in between."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0),
        lambda s, c: F.when(c == "", s).otherwise((s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97),
    )
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def surname(stream: Column, attempt: Column, script: str) -> Column:
    parts = F.transform(F.sequence(F.lit(0), F.lit(2) + F.floor(attempt / 2).cast("int")), lambda i: pick(
        SYLLABLES[script], F.conv(F.substr(stream, (i * 4 % 116 + 9).cast("int"), F.lit(4)), 16, 10).cast("int")))
    return F.initcap(F.array_join(parts, ""))


def payload(key: str, kind: Column, norm: Column, gender: Column, attempt: Column) -> Column:
    """The surrogate of a part, before it takes the format of a surface."""
    s = hash_stream(key, kind, norm, attempt)
    # more characters for each attempt beyond the first few, of the value's own kind
    more = lambda chars: F.substr(chars, F.lit(1), F.greatest(F.lit(0), F.least(F.lit(128), 2 * (attempt - GROW_AFTER))).cast("int"))
    digits = more(F.translate(F.reverse(s), "abcdef", "012345"))
    hexadecimal = norm.rlike("^[0-9A-Fa-f]{16,}$")
    size = F.length(norm)
    head = lambda n: F.substring(norm, 1, n)
    tail = lambda n: F.substr(shaped(norm, s), F.lit(n + 1))
    code, national = F.substring_index(norm, "|", 1), F.substring_index(norm, "|", -1)
    prefix = F.regexp_extract(norm, f"^({'|'.join(TOKEN_PREFIXES)})", 1)
    groups = F.concat_ws(":", *(F.substring(s, 4 * i + 1, 4) for i in range(6)))
    out = (
        F.when(kind == "secret", F.concat(F.when(hexadecimal, shaped(norm, s, True)).otherwise(shaped(norm, s)), more(F.reverse(s))))
        .when(kind == "domain", F.concat(F.lit("d"), F.conv(F.substring(s, 1, 10), 16, 10), digits, F.lit(".example.net")))
        .when(kind == "card", luhn(F.concat(head(1), F.substr(shaped(norm, s), F.lit(2), (size - 2).cast("int")), digits)))
        .when(kind == "ip", F.concat_ws(".", *((byte_of(s, i) % 254 + 1).cast("string") for i in range(4))))
        .when(kind == "ipv6", F.concat(F.lit("2001:db8:"), groups))
        .when(kind == "phone", F.concat(code, F.lit("|"), (byte_of(s, 60) % 8 + 2).cast("string"), F.substr(shaped(national, s), F.lit(2)), digits))
        .when(kind == "ssn", F.concat(F.lit("9"), tail(1), digits))
        .when(kind == "iban", iban(head(2), F.concat(tail(4), digits)))
        .when(kind == "aws", F.concat(head(4), tail(4), F.upper(more(F.reverse(s)))))
        .when(kind == "jwt", F.concat(head(3), tail(3), more(F.reverse(s))))
        .when(kind == "prefixed", F.concat(prefix, F.substr(shaped(norm, s), F.length(prefix) + 1), more(F.reverse(s))))
    )
    # a dotted address leaves the usual four numbers only when these are used up
    out = F.when((kind == "ip") & (attempt > GROW_AFTER), F.concat(out, F.lit("."), digits)).otherwise(out)
    for script, suffix, ends in (("lat", "", {"f": "a", "m": "o"}), ("cyr", "_cyr", {"f": "а", "m": "ий"})):
        last = surname(s, attempt, script)
        double = F.concat(last, F.lit("-"), surname(F.reverse(s), attempt, script))
        out = F.when(kind == f"last_{script}", F.when(norm.contains("-"), double).otherwise(last)).otherwise(out)
        for g in ("m", "f"):
            given = F.when(attempt == 0, pick(GIVEN[g + suffix], number_of(s, 1))).otherwise(F.concat(surname(s, attempt, script), F.lit(ends[g])))
            out = F.when((kind == f"given_{script}") & (gender == g), given).otherwise(out)
    # an e-mail box gets longer with each failed attempt, as short ones leave few choices
    box = F.concat(shaped(norm, s), F.when(attempt > 1, F.concat(F.lit("."), F.substring(s, 60, 8), more(F.reverse(s)))).otherwise(F.lit("")))
    return F.when(kind == "email", box).otherwise(out)


def resolve(parts: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """type, norm, payload: distinct surrogates for distinct parts. A round looks only at the parts whose surrogate clashed in the one before."""
    count = lambda g: F.count(F.when(F.col("gender") == g, 1))
    start = parts.groupBy("type", "norm").agg(count("f").alias("n_f"), count("m").alias("n_m"))
    start = start.select("type", "norm", name_gender(F.col("norm"), F.col("n_f"), F.col("n_m")).alias("gender"))
    start = scratch.store("distinct", start)
    real = start.select(F.col("type").alias("type_r"), F.lower("norm").alias("real")).distinct()
    done, now, attempt = None, start, 0
    while True:
        made = now.withColumn("payload", payload(key, F.col("type"), F.col("norm"), F.col("gender"), F.lit(attempt))).withColumn("low", F.lower("payload"))
        made = scratch.store(f"made-{attempt}", made)
        # of parts with one surrogate the first keeps it, unless an earlier round has given it away or it is real
        first = made.groupBy(F.col("type").alias("type_f"), F.col("low").alias("low_f")).agg(F.min("norm").alias("first"))
        checked = made.join(first, (F.col("type") == F.col("type_f")) & (F.col("low") == F.col("low_f")))
        checked = checked.join(real, (F.col("type") == F.col("type_r")) & (F.col("low") == F.col("real")), "left")
        fails = (F.col("norm") != F.col("first")) | F.col("real").isNotNull()
        if done is not None:
            taken = done.select(F.col("type").alias("type_t"), F.lower("payload").alias("taken"))
            checked = checked.join(taken, (F.col("type") == F.col("type_t")) & (F.col("low") == F.col("taken")), "left")
            fails = fails | F.col("taken").isNotNull()
        checked = scratch.store(f"checked-{attempt}", checked.select("type", "norm", "gender", "payload", fails.alias("fails")))
        good = checked.filter(~F.col("fails")).select("type", "norm", "payload")
        done = good if done is None else done.unionByName(good)
        now = checked.filter("fails").select("type", "norm", "gender")
        scratch.drop(f"made-{attempt}")
        if now.isEmpty():
            return done
        attempt += 1


def rendered(kind: Column, surface: Column, value: Column, other: Column) -> Column:
    """The surrogate in the format of the surface; ``other`` is the domain or the given name."""
    place = lambda i, chars: F.length(only(F.substr(surface, F.lit(1), i.cast("int")), chars)) + 1
    refill = lambda chars, value: F.concat(
        F.array_join(
            F.transform(
                F.split(surface, ""),
                lambda c, i: F.when(c.rlike(f"[{chars}]"), F.substr(value, place(i, chars).cast("int"), F.lit(1))).otherwise(c),
            ),
            "",
        ),
        F.substr(value, (F.length(only(surface, chars)) + 1).cast("int")),  # what a longer surrogate has more
    )
    title = F.regexp_extract(surface, r"^(\S+ )", 1)
    return (
        F.when(kind == "email", F.concat_ws("@", value, other))
        .when(kind == "secret", F.concat(secret_head(surface), value, closing_quote(surface)))
        .when(kind.isin("card", "ssn"), refill("0-9", value))
        .when(kind == "phone", refill("0-9", F.concat(calling_code(surface), F.substring_index(value, "|", -1))))
        .when(kind == "iban", refill("0-9A-Z", value))
        .when(kind == "name", F.concat(title, F.when(other.isNull(), value).otherwise(F.concat_ws(" ", other, value))))
        .otherwise(value)
    )


def surrogate_table(surfaces: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """surface, type, surrogate for each distinct surface."""
    s = surfaces.select("surface").distinct().withColumn("kind", entity_type(F.col("surface")))
    parts = scratch.store("parts", s.select("surface", "kind", F.inline(entity_parts(F.col("kind"), F.col("surface")))))
    found = parts.join(resolve(parts, key, scratch), ["type", "norm"])
    slots = found.groupBy("surface", "kind").agg(
        F.max(F.when(F.col("slot") == "v", F.col("payload"))).alias("value"), F.max(F.when(F.col("slot") != "v", F.col("payload"))).alias("other")
    )
    return slots.select("surface", "kind", rendered(F.col("kind"), F.col("surface"), F.col("value"), F.col("other")).alias("surrogate"))


def find_entities(docs: DataFrame) -> DataFrame:
    """row_id, row_hash, found: the surfaces of each text that has any, in order."""
    return (
        docs.filter(F.col("text").rlike(HINT))
        .select(
            F.col("doc_id").cast("long").alias("row_id"), F.xxhash64("text").alias("row_hash"),
            F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)).alias("found"),
        )
        .filter(F.size("found") > 0)
    )


def anonymize(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """The documents with entities replaced in ``text``; ``count`` names a new column with the number of replacements."""
    if not key:
        raise ValueError("surrogates need a key that is not empty")
    if count in docs.columns:
        raise ValueError(f"the documents have a column {count} already")
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.store("found", find_entities(docs)).dropDuplicates(["row_id", "row_hash"])
    places = found.select("row_id", "row_hash", F.posexplode("found").alias("place", "surface"))
    table_ = scratch.store("surrogates", surrogate_table(places, key, scratch))
    new = (
        places.join(table_, "surface")
        .groupBy("row_id", "row_hash")
        .agg(F.array_sort(F.collect_list(F.struct("place", "surrogate"))).alias("new"))
        .select("row_id", "row_hash", F.col("new.surrogate").alias("pii_new"))
    )
    new = scratch.store("new", new)
    scratch.keep("new")
    # only documents that may have entities are shuffled with their texts; as many as they are, their surrogates are never broadcast
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.xxhash64("text").alias("h"))
    likely, rest = split_likely(rows, "h", new.select(F.col("row_hash").alias("h")))
    same = (F.col("h") == F.col("row_hash")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("row_id"))
    likely = likely.join(new.hint("merge"), same, "left").select("d", "pii_new")
    rows = likely.unionByName(rest.select("d", F.lit(None).cast("array<string>").alias("pii_new")))
    old = F.split(F.col("d.text"), ENTITY, -1)
    filled = F.array_join(F.zip_with(old, F.col("pii_new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.col("pii_new").isNull(), F.col("d.text")).otherwise(filled).alias("text")
    cols = [text if c == "text" else F.col(f"d.`{c}`") for c in docs.columns]
    if count:
        cols.append(F.coalesce(F.size("pii_new"), F.lit(0)).cast("long").alias(count))
    return rows.select(*cols)


#: Keys of applications that were given none.
_MADE_KEYS: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The key of the session's setting. Without one a random key is made, once an application: nobody can compute its surrogates
    again, and another application gives others."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: surrogates are made with a random key of this application", stacklevel=2)
        key = _MADE_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
    return key


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return anonymize(docs, key_of(spark), "n_entities")
