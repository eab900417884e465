"""Personal data replaced by keyed surrogates of the same kind and format, in built-in column functions only."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableweave.llm.quality_rules import bound
from tableweave.plans.materialize import cut, hinted

# Titles by gender, given names by gender, syllables of surnames by script.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Госпожа"]
OTHER_TITLES = ["Dr", "Prof"]
GIVEN = {
    "male": ["Adam", "Bruno", "Carl", "David", "Edgar", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Lukas", "Martin", "Nils", "Oscar", "Paul"],
    "female": ["Alma", "Berta", "Clara", "Doris", "Elena", "Flora", "Greta", "Helen", "Irma", "Julia", "Katja", "Laura", "Maria", "Nora", "Olga", "Paula"],
    "any": ["Alex", "Andrea", "Chris", "Dominique", "Eden", "Francis", "Gabriele", "Jamie", "Kim", "Luca", "Marion", "Nicola", "Pat", "Robin", "Sascha", "Toni"],
}
GIVEN_CYRILLIC = {
    "male": ["Адам", "Борис", "Вадим", "Глеб", "Денис", "Егор", "Захар", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён"],
    "female": ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Инна", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Рита"],
}
SYLLABLES = ["ba", "co", "de", "fi", "ga", "hu", "ki", "lo", "ma", "ne", "po", "ra", "se", "ti", "vo", "zu"]
GIVEN_GREEK = {
    "male": ["Άγγελος", "Βασίλης", "Γιώργος", "Δημήτρης", "Ευάγγελος", "Ζήσης", "Θανάσης", "Ιάσων", "Κώστας", "Λουκάς", "Μιχάλης", "Νίκος", "Ορέστης", "Παύλος", "Σπύρος", "Τάσος"],
    "female": ["Άννα", "Βάσω", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Θεοδώρα", "Ιωάννα", "Κατερίνα", "Λίνα", "Μαρία", "Νίκη", "Ολυμπία", "Πόπη", "Σοφία", "Τασία"],
}
SYLLABLES_GREEK = ["βα", "κο", "δε", "φι", "γα", "χυ", "κι", "λο", "μα", "νε", "πο", "ρα", "σε", "τι", "θο", "ζυ"]
SYLLABLES_CYRILLIC = ["ба", "ко", "де", "фи", "га", "ху", "ки", "ло", "ма", "не", "по", "ра", "се", "ти", "во", "зу"]
# What each of the sixteen hexadecimal digits becomes.
HEX, DIGITS = "0123456789abcdef", "0123456789012345"
LATIN, CYRILLIC, GREEK = "bcdfghjklmnprstv", "бвгджзклмнпрстфх", "βγδζηθκλμνξπρστφ"
#: Sixteen letters of other scripts; a letter of any script that isn't here becomes a Latin one.
OTHER_SCRIPTS = {
    "Cyrillic": CYRILLIC, "Greek": GREEK, "Han": "安北成大东高海江金林明南平山天文", "Hiragana": "あいうえおかきくけこさしすせそた",
    "Katakana": "アイウエオカキクケコサシスセソタ", "Hangul": "가나다라마바사아자차카타파하거너", "Arabic": "بتثجحخدرزسشصطعفق",
    "Hebrew": "אבגדהוזחטיכלמנסע", "Thai": "กขคงจฉชซฌญดตถทธน", "Devanagari": "कखगघचछजझटठडढतथदध",
}
SYMBOLS = "!#$%&*+-/:;=?@^~"

# Patterns, in Java's syntax.
JUNK = r"[!#$%&*]{0,3}"
TITLES = MALE_TITLES + FEMALE_TITLES + OTHER_TITLES
TITLE = "(?:" + "|".join(TITLES) + ")"
UPPER_TITLE = "(?:" + "|".join(x.upper() for x in TITLES) + ")"
# Several titles may stand in a row, and two blanks where one is meant.
GAP = "[ \u00a0]{1,2}"
# The titles at the start of a mention, in any case; what may follow a name and isn't part of it.
LEADING_TITLE = rf"^(?iu:(?:{TITLE})\.?{GAP})+"
SUFFIXES = ["Jr", "Sr", "II", "III", "IV"]
SUFFIX = rf",?{GAP}(?i:{'|'.join(SUFFIXES)})\.?$"
# Each begins with what fails fastest: most places of a text are looked at by all of them.
# Name words: an initial, or letters with parts after an apostrophe (but not a genitive's s) or a hyphen.
PARTS = r"(?:['’](?![sS](?![\p{L}]))\p{L}++|-\p{Lu}[\p{L}\p{M}]*+)*+"
WORD = rf"(?:\p{{Lu}}\.|(?:\p{{Lu}}['’])?+\p{{Lu}}[\p{{L}}\p{{M}}]++{PARTS})"
# In scripts without case any word of letters.
WORD = rf"(?:{WORD}|\p{{Lo}}[\p{{Lo}}\p{{Lm}}\p{{M}}]*+)"
PARTICLE = rf"(?:(?:von|van|de|del|della|der|den|di|da|du|la|le|ter|zu|zur|bin|al|el){GAP}){{0,3}}+"
AFTER = rf"(?:,?{GAP}(?:Jr|Sr)\.?|{GAP}(?:III|II|IV))?+"
UPPER_WORD = r"(?:\p{Lu}\.|\p{Lu}(?:['’](?!S(?![\p{L}]))|-)?+\p{Lu}(?:[\p{Lu}\p{M}]|['’](?!S(?![\p{L}]))(?=\p{Lu})|-(?=\p{Lu}))*+)"
NAME = (
    rf"(?=[DFHMPSГ])(?<![\p{{L}}\p{{N}}])(?:(?:{TITLE}\.?{GAP})++{PARTICLE}{WORD}(?:{GAP}(?!(?:Jr|Sr|II|III|IV)(?![\p{{L}}\p{{N}}])){PARTICLE}{WORD}){{0,3}}{AFTER}"
    rf"|(?:{UPPER_TITLE}\.?{GAP})++{UPPER_WORD}(?:{GAP}(?!(?:JR|SR|II|III|IV)(?![\p{{L}}\p{{N}}])){UPPER_WORD}){{0,3}}(?:,?{GAP}(?:JR|SR)\.?|{GAP}(?:III|II|IV))?+)(?![\p{{L}}\p{{N}}])"
)
KEY_WORDS = ["token", "secret", "passw", "api"]
KEY = r"(?i:token|secret|password|passwd|api[_-]?key)[\"']?[!#$%&*]{0,3}\s{0,2}"
# Unquoted values are right behind an equals sign, or have a digit.
BARE = r"[^\s\"'`<>()\[\]{}]"
HEXADECIMAL = r"(?=[0-9A-Fa-f])(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+)(?![\p{L}\p{N}])"
SECRET = (
    rf"(?<=[\"'])(?<={KEY}[=:][!#$%&*]{{0,3}}\s{{0,2}}[\"'])[^\s\"']{{8,}}+(?=[\"'])"
    rf"|(?=[^\s\"'=:])(?<=[=:\s])(?<=[=:]\s{{0,2}})(?:(?<={KEY}=)|(?<={KEY}[=:]\s{{0,2}})(?={BARE}*[0-9])){BARE}{{7,}}[^\s\"'`<>()\[\]{{}}.,;:?](?![(\[{{\"'`])"
    rf"|{HEXADECIMAL}"
)
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP = rf"(?=[0-9])(?<![\p{{L}}\p{{N}}.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[\p{{L}}\p{{N}}])"
H16 = "[0-9A-Fa-f]{1,4}"
# Either all groups, or '::' with a digit and a group of three digits or more: no times, slices or qualified names.
IP6 = (
    rf"(?=[0-9A-Fa-f:])(?<![\p{{L}}\p{{N}}:.])(?:(?:{H16}:){{7}}{H16}|(?:{H16}:){{6}}(?:{OCTET}\.){{3}}{OCTET}"
    rf"|(?=[A-Fa-f:]*[0-9])(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{{3}})(?:{H16}(?::{H16}){{0,5}})?::(?:(?:{H16}:){{0,5}}(?:{OCTET}\.){{3}}{OCTET}|{H16}(?::{H16}){{0,5}})?)"
    r"(?![\p{L}\p{N}:]|\.[0-9])"
)
# Ten digits in 3-3-4, with one kind of separator.
TEN = rf"(?:1[ .-])?[0-9]{{3}}(?:-[0-9]{{3}}-|\.[0-9]{{3}}\.|{JUNK} [0-9]{{3}}{JUNK} )[0-9]{{4}}"
PHONE = (
    rf"\+(?<![\p{{L}}\p{{N}}+]\+)[0-9]{{1,3}}{JUNK}[ .-]?\(?[0-9]{{2,4}}\)?(?:{JUNK}[ .-]?[0-9]{{2,4}}){{2,4}}(?![\p{{L}}\p{{N}}])"
    rf"|\([0-9]{{3}}\){JUNK}[ .-]?[0-9]{{3}}{JUNK}[ .-][0-9]{{4}}(?![\p{{L}}\p{{N}}])"
    rf"|(?=[0-9])(?<![\p{{L}}\p{{N}}.,+/-]){TEN}(?![.,/-]?[\p{{L}}\p{{N}}])"
)
SSN = r"(?=[0-9])(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"
CARD = r"(?=[0-9])(?<![\p{L}\p{N}.])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![\p{L}\p{N}])"
IBAN = r"(?=[A-Z])(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])"
#: The first group tells secrets from all else.
PATTERN = "|".join((f"({SECRET})", EMAIL, IP6, IP, PHONE, SSN, CARD, IBAN, NAME))
#: The same for texts without a key word of secrets: only the last kind of secret can be there. Looking behind is what costs most.
KEYLESS = "|".join((f"({HEXADECIMAL})", EMAIL, IP6, IP, PHONE, SSN, CARD, IBAN, NAME))
#: Marks of mentions, characters that no text should have; where one has, it is written as two others meanwhile.
BEGIN, MIDDLE, END, ESCAPE = "\uFDD0", "\uFDD1", "\uFDD2", "\uFDD3"
ESCAPES = [(ESCAPE, ESCAPE + "."), (BEGIN, ESCAPE + "0"), (MIDDLE, ESCAPE + "1"), (END, ESCAPE + "2")]
#: What every text with a match has: one cheap look spares most texts the whole pattern.
HINT = rf"[@0-9\"'=:]|(?=[DFHMPSГ])(?:{TITLE}|{UPPER_TITLE})\.?{GAP}[\p{{Lu}}\p{{Lo}}a-z]"
#: Draws of one length and format; what has no free surrogate by then gets a longer one, or the next free one of its format.
LONGER_AFTER, ROUNDS = 8, 40
#: Kinds whose surrogates can't be longer.
FIXED = ["ip", "phone", "ssn", "card", "iban"]
DRAWN = 128
#: Numbers of a format that are counted through at once.
PART = 4096


def kind_of(found: Column, secret: Column) -> Column:
    """``secret`` tells whether the pattern's branch of secrets matched: what it finds may look like anything."""
    return (
        F.when(secret, "secret")
        .when(found.contains("@"), "email")
        .when(found.rlike(LEADING_TITLE), "name")
        .when(found.contains(":"), "ip6")
        .when(found.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "ip")
        .when(found.rlike(rf"^[+(]|^{TEN}$"), "phone")
        .when(found.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(found.rlike(r"^[0-9 -]+$"), "card")
        .otherwise("iban")
    )


def normal_of(found: Column, kind: Column) -> Column:
    """What mentions of one entity have in common: case and separators don't count, nor does a name's title."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    return (
        F.when((kind == "phone") & found.startswith("+"), F.concat(F.lit("+"), digits))
        .when(kind.isin("phone", "ssn", "card"), digits)
        .when(kind == "iban", F.lower(F.regexp_replace(found, " ", "")))
        .when(kind == "name", F.concat(gender_of(found), F.lit(":"), F.translate(F.lower(bare_name(found)), "’", "'")))
        .otherwise(F.lower(found))
    )


def bare_name(found: Column) -> Column:
    """A name without titles and what follows it, with single blanks."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(found, LEADING_TITLE, ""), SUFFIX, ""), GAP, " ")


def gender_of(name: Column) -> Column:
    """That of the first title that has one."""
    male, female, other = ("|".join(x) for x in (MALE_TITLES, FEMALE_TITLES, OTHER_TITLES))
    first = lambda x: name.rlike(rf"^(?iu:(?:(?:{other})\.?{GAP})*(?:{x})\.?{GAP})")
    return F.when(first(male), "male").when(first(female), "female").otherwise("any")


def drawn(kind: Column, normal: Column, key: str, attempt: int) -> Column:
    """DRAWN hexadecimal digits that depend on the key, the entity and the attempt."""
    return F.sha2(F.concat_ws("\u001f", F.lit(key), kind, F.lit(str(attempt)), normal), 512)


def _at(s: Column, i: Column) -> Column:
    return F.substring(s, F.pmod(i - 1, F.lit(DRAWN)) + 1, F.lit(1))


def _pick(values: list[str], hex_digit: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.conv(hex_digit, 16, 10).cast("int") + 1)


def shaped(normal: Column, draw: Column, first: Column, last: Column, symbols: bool = False) -> Column:
    """``normal`` with the characters at first..last drawn anew, each by one of its own script; the others stay.

    Characters that are neither letters nor numbers stay too, unless ``symbols``.
    """

    def one(i: Column) -> Column:
        c, x = F.substring(normal, i, F.lit(1)), _at(draw, i)
        other = F.translate(x, HEX, SYMBOLS) if symbols else c
        drawn_anew = (
            F.when((i < first) | (i > last), c)
            .when(c.rlike("[0-9]"), F.translate(x, HEX, DIGITS))
            .when(c.rlike(r"\p{IsLatin}"), F.translate(x, HEX, LATIN))
            .when(c.rlike(r"\p{ASCII}"), other)
        )
        for script, letters in OTHER_SCRIPTS.items():
            drawn_anew = drawn_anew.when(c.rlike(rf"\p{{Is{script}}}"), F.translate(x, HEX, letters))
        return drawn_anew.when(c.rlike(r"\p{N}"), F.translate(x, HEX, DIGITS)).when(c.rlike(r"[\p{L}\p{M}]"), F.translate(x, HEX, LATIN)).otherwise(other)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(normal), F.lit(1))), one), "")


def check_digit(digits: Column) -> Column:
    """What the last digit would have to be for the Luhn sum to end in zero."""
    n = F.char_length(digits)

    def one(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n - 1), one), F.lit(0), lambda s, d: s + d)
    return F.pmod(-total, F.lit(10))


def luhn_valid(normal: Column) -> Column:
    return check_digit(normal) == F.substring(normal, F.char_length(normal), F.lit(1)).cast("int")


def card_like(normal: Column, draw: Column) -> Column:
    """A card number with the same first digit, valid if ``normal`` is."""
    n = F.char_length(normal)
    body = F.substring(shaped(normal, draw, F.lit(2), n - 1), F.lit(1), n - 1)
    luhn = check_digit(F.concat(body, F.lit("0")))
    return F.concat(body, F.when(luhn_valid(normal), luhn).otherwise(F.pmod(luhn + 1, F.lit(10))).cast("string"))


def _mod97(iban: Column) -> Column:
    """The number that a bank account number stands for, its first four characters last and letters as 10..35, modulo 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.char_length(iban)), F.substring(iban, 1, 4))

    def step(left: Column, c: Column) -> Column:
        digit = F.conv(c, 36, 10).cast("int")
        return F.pmod(left * F.when(digit > 9, 100).otherwise(10) + digit, F.lit(97))

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def iban_like(normal: Column, draw: Column) -> Column:
    """A bank account number of the same country, whose check digits are right if those of ``normal`` are."""
    body = F.substring(shaped(normal, draw, F.lit(5), F.char_length(normal)), F.lit(5), F.char_length(normal))
    country = F.substring(normal, 1, 2)
    right = F.lit(98) - _mod97(F.concat(country, F.lit("00"), body))
    told = F.when(_mod97(normal) == 1, right).otherwise(F.pmod(right, F.lit(97)) + 1)
    return F.concat(country, F.lpad(told.cast("string"), 2, "0"), body)


def candidate(kind: Column, normal: Column, at: Column, key: str, attempt: int) -> Column:
    """A surrogate in normal form; ``at`` is that of an e-mail address' domain. Titles, top-level domains, country codes,
    Luhn validity and that of account numbers are kept.

    From attempt LONGER_AFTER on, those that may be longer are: by eight characters more each time.
    """
    return bound(drawn(kind, normal, key, attempt), lambda draw: _candidate(kind, normal, at, draw, 8 * max(0, attempt - LONGER_AFTER + 1)))


def _candidate(kind: Column, normal: Column, at: Column, draw: Column, more: int) -> Column:
    n = F.char_length(normal)
    octet = lambda k, low, size: (F.pmod(F.conv(F.substring(draw, 1 + 4 * k, 4), 16, 10).cast("int"), F.lit(size)) + low).cast("string")
    ip = F.concat_ws(".", octet(0, 1, 223), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254))
    hexadecimal = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _at(draw, i)), "")
    secret = F.when(normal.rlike("^[0-9]*[a-f][0-9a-f]*$"), hexadecimal).otherwise(shaped(normal, draw, F.lit(1), n, symbols=True))
    return (
        F.when(kind == "email", email_surrogate(normal, at, draw, more))
        .when(kind == "domain", domain_surrogate(normal, draw, more))
        .when(kind == "ip", ip)
        .when(kind == "ip6", ip6_surrogate(normal, draw, ip, more > 0))
        .when(kind == "card", card_like(normal, draw))
        .when(kind == "phone", shaped(normal, draw, phone_first(normal), n))
        .when(kind == "ssn", shaped(normal, draw, F.lit(1), n))
        .when(kind == "iban", iban_like(normal, draw))
        .when(kind == "name", name_surrogate(normal, draw, more // 2))
        .otherwise(F.concat(secret, F.substring(draw, 1, more)))
    )


def email_surrogate(normal: Column, at: Column, draw: Column, more: int) -> Column:
    """A drawn name at the domain's surrogate: addresses of one domain stay together."""
    name = F.substring_index(normal, "@", 1)
    return F.concat(F.translate(F.substring(draw, 1, more), HEX, LATIN), shaped(name, draw, F.lit(1), F.char_length(name)), F.lit("@"), at)


def domain_surrogate(domain: Column, draw: Column, more: int) -> Column:
    end = F.char_length(domain) - F.char_length(F.substring_index(domain, ".", -1))
    return F.concat(F.translate(F.substring(draw, 1, more), HEX, LATIN), shaped(domain, draw, F.lit(1), end))


def ip6_surrogate(normal: Column, draw: Column, ip: Column, longer: bool) -> Column:
    """Other digits in the same groups; an IPv4 end is drawn as such. The longer one has all groups."""
    if longer:
        return F.concat_ws(":", *[F.substring(draw, 1 + 4 * k, 4) for k in range(8)])
    digits = F.transform(F.sequence(F.lit(1), F.char_length(normal)), lambda i: F.when(F.substring(normal, i, F.lit(1)) == ":", ":").otherwise(_at(draw, i)))
    return F.when(normal.contains("."), F.concat(F.regexp_replace(normal, "[^:]*$", ""), ip)).otherwise(F.array_join(digits, ""))


def phone_first(normal: Column) -> Column:
    return F.when(normal.startswith("+"), 3).otherwise(1)


def mould_of(kind: Column, normal: Column) -> Column:
    """What surrogates of one format share: the characters that stay, and the places of the others."""
    zeros = F.translate(normal, "123456789", "000000000")
    return (
        F.when(kind == "ip", "ip")
        .when(kind == "card", F.concat(F.substring(normal, 1, 1), F.substring(zeros, F.lit(2), F.char_length(normal)), F.when(luhn_valid(normal), "+").otherwise("-")))
        .when((kind == "phone") & normal.startswith("+"), F.concat(F.substring(normal, 1, 2), F.substring(zeros, F.lit(3), F.char_length(normal))))
        .when(kind == "iban", F.concat(F.substring(normal, 1, 2), F.translate(F.substring(zeros, F.lit(3), F.char_length(normal)), "acdefghijklmnopqrstuvwxyz", "b" * 25), F.when(_mod97(normal) == 1, "+").otherwise("-")))
        .otherwise(zeros)
    )


def nth_of_mould(kind: Column, normal: Column, nth: Column) -> Column:
    """Surrogate number ``nth`` of the format that ``normal`` has: all numbers give all surrogates, of IBANs those with ten of the letters."""
    n = F.char_length(normal)
    right = F.lpad(nth.cast("string"), n, "0")
    part = lambda over, size, low: (F.pmod(F.floor(nth / over), F.lit(size)) + low).cast("string")
    return (
        F.when(kind == "ip", F.concat_ws(".", part(254 * 65536, 223, 1), part(254 * 256, 256, 0), part(254, 256, 0), part(1, 254, 1)))
        .when(kind == "card", card_like(normal, F.concat(F.substring(right, F.lit(2), n), F.lit("0"))))
        .when(kind == "phone", shaped(normal, right, phone_first(normal), n))
        .when(kind == "ssn", shaped(normal, right, F.lit(1), n))
        .otherwise(iban_like(normal, right))
    )


def space_of(kind: Column, normal: Column) -> Column:
    """How many numbers ``nth_of_mould`` takes."""
    kept = F.when(kind == "phone", phone_first(normal) - 1).when(kind == "ssn", 0).when(kind == "iban", 4).otherwise(2)
    return F.when(kind == "ip", 223 * 65536 * 254).otherwise(F.pow(F.lit(10.0), F.least(F.char_length(normal) - kept, F.lit(15)))).cast("long")


def enumerated(rest: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """``kind, normal, surrogate`` for what drawing left over: each the next free surrogate of its format.

    Of a format with u used ones and r left over, the first u + r in order hold r free ones, if there are as many at all.
    """
    form = ["kind", "mould"]
    rest = rest.withColumn("mould", mould_of(F.col("kind"), F.col("normal")))
    taken = used.withColumn("mould", mould_of(F.col("kind"), F.col("surrogate"))).groupBy(form).agg(F.count(F.lit(1)).alias("u"))
    forms = rest.groupBy(form).agg(F.min("normal").alias("one"), F.count(F.lit(1)).alias("r")).join(taken, form, "left")
    forms = forms.withColumn("n", F.least(F.col("r") + F.coalesce("u", F.lit(0)), space_of(F.col("kind"), F.col("one"))))
    # A range of numbers is cut into parts, so that no row or task holds all of a format; places are those in the part and the parts before.
    last = F.floor((F.col("n") - 1) / PART)
    parts = forms.select(*form, "one", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long")))).alias("part"))
    numbers = parts.select(*form, "one", "part", F.explode(F.sequence(F.col("part") * PART, F.least(F.col("n"), (F.col("part") + 1) * PART) - 1)).alias("nth"))
    free = numbers.withColumn("surrogate", nth_of_mould(F.col("kind"), F.col("one"), F.col("nth"))).join(used, ["kind", "surrogate"], "left_anti")
    rest = rest.withColumn("hash", F.sha2(F.concat(F.lit(key), "normal"), 256)).withColumn("part", F.conv(F.substring("hash", 1, 3), 16, 10).cast("long"))

    def ranked(df: DataFrame, by: str, label: str) -> DataFrame:
        df = cut(df, label)
        before = F.sum("m").over(Window.partitionBy(form).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        sums = df.groupBy(*form, "part").agg(F.count(F.lit(1)).alias("m")).select(*form, "part", F.coalesce(before, F.lit(0)).alias("before"))
        own = F.row_number().over(Window.partitionBy(*form, "part").orderBy(by))
        return df.withColumn("own", own).join(sums, [*form, "part"]).withColumn("rank", F.col("before") + F.col("own"))

    both = ranked(rest.select(*form, "part", "normal", "hash"), "hash", "pii-left").select(*form, "rank", "normal")
    return both.join(ranked(free.select(*form, "part", "surrogate", "nth"), "nth", "pii-free").select(*form, "rank", "surrogate"), [*form, "rank"]).select("kind", "normal", "surrogate")


def name_surrogate(normal: Column, draw: Column, more: int = 0) -> Column:
    """``gender: [given] surname``: a given name of the gender where there was one, a surname of five drawn syllables and ``more``."""
    gender, own = F.substring_index(normal, ":", 1), F.substring_index(normal, ":", -1)
    cyrillic, greek = own.rlike(r"\p{IsCyrillic}"), own.rlike(r"\p{IsGreek}")

    def surname(values: list[str]) -> Column:
        return F.concat(*[_pick(values, _at(draw, F.lit(10 + k))) for k in range(5 + more)])

    first = F.substring(draw, 1, 1)
    latin_given = F.when(gender == "male", _pick(GIVEN["male"], first)).when(gender == "female", _pick(GIVEN["female"], first)).otherwise(_pick(GIVEN["any"], first))
    cyrillic_given = F.when(gender == "female", _pick(GIVEN_CYRILLIC["female"], first)).otherwise(_pick(GIVEN_CYRILLIC["male"], first))
    greek_given = F.when(gender == "female", _pick(GIVEN_GREEK["female"], first)).otherwise(_pick(GIVEN_GREEK["male"], first))
    given = F.lower(F.when(cyrillic, cyrillic_given).when(greek, greek_given).otherwise(latin_given))
    family = F.when(cyrillic, surname(SYLLABLES_CYRILLIC)).when(greek, surname(SYLLABLES_GREEK)).otherwise(surname(SYLLABLES))
    given = F.when(own.rlike(r"^\p{L}\. "), F.concat(F.substring(given, 1, 1), F.lit("."))).otherwise(given)
    # in scripts without case each character is drawn anew, by one of its script
    n = F.char_length(own)
    caseless = shaped(F.substring(F.repeat(own, more + 1), F.lit(1), n + more), draw, F.lit(1), n + more)
    told = F.when(own.rlike(r"\p{Lo}"), caseless).when(own.contains(" "), F.concat(given, F.lit(" "), family)).otherwise(family)
    return F.concat(gender, F.lit(":"), told)


def dressed(found: Column, kind: Column, surrogate: Column) -> Column:
    """A surrogate in the format of the mention: its separators, its upper and lower case, its title."""
    plain = F.when(surrogate.startswith("+"), F.substring(surrogate, 2, 1000)).otherwise(surrogate)

    def digit(i: Column) -> Column:
        c = F.substring(found, i, F.lit(1))
        nth = F.char_length(F.regexp_replace(F.substring(found, F.lit(1), i), "[^0-9A-Za-z]", ""))
        x = F.substring(plain, nth, F.lit(1))
        return F.when(c.rlike("[A-Z]"), F.upper(x)).when(c.rlike("[0-9]"), x).otherwise(c)

    def letter(i: Column) -> Column:
        c, x = F.substring(found, i, F.lit(1)), F.substring(surrogate, i, F.lit(1))
        return F.when(c.rlike(r"\p{Lu}"), F.upper(x)).otherwise(x)

    places = F.sequence(F.lit(1), F.greatest(F.char_length(found), F.lit(1)))
    title, suffix = F.regexp_extract(found, LEADING_TITLE, 0), F.regexp_extract(found, SUFFIX, 0)
    name = F.substring_index(surrogate, ":", -1)
    alike = F.char_length(found) == F.char_length(surrogate)
    return (
        F.when(kind == "name", F.concat(title, F.when(found.rlike(r"\p{Ll}|^\P{Lu}*$"), F.initcap(name)).otherwise(F.upper(name)), suffix))
        .when(kind == "ip", surrogate)
        .when(kind.isin("phone", "ssn", "card", "iban"), F.array_join(F.transform(places, digit), ""))
        .when(~found.rlike(r"\p{Ll}"), F.upper(surrogate))
        .when(alike, F.array_join(F.transform(places, letter), ""))
        .otherwise(surrogate)
    )


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, normal, surrogate`` for distinct ``kind, normal``: no two alike, and none that is itself an entity.

    Each entity draws a surrogate; where several draw the same, or one that is taken or real, the least entity gets it if
    it is free and the others draw again. What an entity gets depends on the key, itself and the entities it collides with.
    Domains of e-mail addresses are drawn first, as entities of their own. No two names share their last word.

    After LONGER_AFTER draws, e-mail addresses, names and secrets get longer surrogates. The other kinds can't be longer:
    after ROUNDS draws theirs are counted through (``enumerated``), and it is an error if really all of a format are taken.
    """
    entities = entities.select("kind", "normal", F.when(F.col("kind") == "email", F.substring_index("normal", "@", -1)).alias("domain"))
    domains = entities.filter("domain IS NOT NULL").select(F.lit("domain").alias("kind"), F.col("domain").alias("normal"), F.lit(None).cast("string").alias("at")).distinct()
    at = _assigned(cut(domains, "pii-domains"), key).select(F.col("normal").alias("domain"), F.col("surrogate").alias("at"))
    return _assigned(cut(entities.join(hinted(cut(at, "pii-domains-given")), "domain", "left").select("kind", "normal", "at"), "pii-drawing"), key)


def _told_by(surrogate: Column, kind: Column) -> Column:
    """What no two surrogates share: of names the last word, since a person may be called by it alone."""
    return F.when(kind == "name", F.concat(F.lit(":"), F.regexp_extract(surrogate, r"[^ :]*$", 0))).otherwise(surrogate)


def _assigned(entities: DataFrame, key: str) -> DataFrame:
    """The draws of ``assign_surrogates`` for ``kind, normal, at``."""
    kind = F.col("kind")
    real = entities.select("kind", F.col("normal").alias("surrogate"), _told_by(F.col("normal"), kind).alias("told")).distinct()
    # little to read, much to compute: as many tasks as the session's, whatever the bytes
    n = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given, rest = None, entities.repartition(n, "kind", "normal")
    for attempt in count():
        tried = rest.withColumn("surrogate", candidate(kind, F.col("normal"), F.col("at"), key, attempt))
        tried = cut(tried.withColumn("told", _told_by(F.col("surrogate"), kind)), "pii-tried")
        free = tried.join(real.select("kind", "told"), ["kind", "told"], "left_anti")
        if given is not None:
            free = free.join(given.select("kind", "told"), ["kind", "told"], "left_anti")
        won = free.groupBy("kind", "told").agg(F.min_by(F.struct("normal", "surrogate"), "normal").alias("won")).select("kind", "won.normal", "won.surrogate", "told")
        given = cut(won if given is None else given.unionByName(won), "pii-given")
        rest = cut(tried.select("kind", "normal", "at").join(given, ["kind", "normal"], "left_anti"), "pii-rest")
        if attempt + 1 == ROUNDS and not (fixed := rest.filter(kind.isin(FIXED))).isEmpty():
            counted = enumerated(fixed.select("kind", "normal"), real.select("kind", "surrogate").unionByName(given.select("kind", "surrogate")), key)
            given = cut(given.unionByName(counted.withColumn("told", F.col("surrogate"))), "pii-counted")
            rest = cut(rest.join(given, ["kind", "normal"], "left_anti"), "pii-rest")
            if not rest.filter(kind.isin(FIXED)).isEmpty():
                raise ValueError("all surrogates of a format are taken")
        if rest.isEmpty():
            return given.select("kind", "normal", "surrogate")


def without_doctors(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities but for names under a title of no gender that are there under titles of one gender too, and those:
    ``normal, same`` says that Dr. Smith is the Mr. Smith of the table. With both genders nobody can tell, so he or she is another.
    """
    names = entities.filter("kind = 'name'").select("normal", F.substring_index("normal", ":", 1).alias("gender"), F.substring_index("normal", ":", -1).alias("own"))
    owns = names.groupBy("own").agg(F.count_if(F.col("gender") == "any").alias("any"), F.max(F.when(F.col("gender") != "any", F.col("normal"))).alias("same"), F.count(F.lit(1)).alias("n"))
    same = cut(owns.filter("any = 1 AND n = 2").select(F.concat(F.lit("any:"), "own").alias("normal"), "same"), "pii-same")
    return entities.join(same.select(F.lit("name").alias("kind"), "normal"), ["kind", "normal"], "left_anti"), same


def full_names(mentions: DataFrame) -> DataFrame:
    """``__id, normal, full``: a name of one word stands for the full name of its text that ends in it, if there is just one
    and their genders don't differ."""
    names = mentions.filter("kind = 'name'").select("__id", "normal", F.substring_index("normal", ":", 1).alias("gender"), F.substring_index("normal", ":", -1).alias("own")).distinct()
    last = F.substring_index("own", " ", -1).alias("last")
    short = names.filter(~F.col("own").contains(" ")).select("__id", "normal", F.col("gender").alias("g"), F.col("own").alias("last"))
    whole = names.filter(F.col("own").contains(" ")).select("__id", F.col("normal").alias("full"), "gender", last)
    both = short.join(whole, ["__id", "last"]).filter("g = gender OR g = 'any' OR gender = 'any'")
    return both.groupBy("__id", "normal").agg(F.min("full").alias("full"), F.count_distinct(F.substring_index("full", ":", -1)).alias("n")).filter("n = 1").drop("n")


def replace_personal_data(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced, and a column ``n_entities`` (mentions; it replaces one of that name).

    E-mail and IP addresses, phone, card, social security and bank account numbers, secrets and titled names become
    others of the same kind and format. Mentions of one entity, in any case or punctuation, get one surrogate all over the
    table; different entities get different ones (``assign_surrogates``). Names of several words are also replaced where
    they stand without a title in a text that has them with one, and a titled surname is the person of that name in its
    text, if there is just one. Titles, also several, and a Jr or III stay. Null text stays null; texts without personal data stay as
    they are; repeated rows give repeated results. All other columns stay, whatever their names.

    Rows that may have mentions alone are written and joined; for the others the pass is narrow. An entity in many rows is
    joined by a broadcast of counted size or a join that Spark may split.
    """
    own = docs.columns
    text = F.col(f"`{text_col}`")
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row")
    read = docs.select(row, F.coalesce(text.rlike(HINT), F.lit(False)).alias("__hint"))
    clean = read.filter("NOT __hint").select("__row", F.lit(0).alias("__n"), F.col(f"__row.`{text_col}`").alias("__text"))
    # one pass of the pattern: every mention between marks, what is a secret before it
    raw = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, F.col(f"__row.`{text_col}`"))
    keyed = reduce(lambda a, b: a | b, [F.lower(raw).contains(k) for k in KEY_WORDS])
    marks = f"{BEGIN}$1{MIDDLE}$0{END}"
    marked = F.when(keyed, F.regexp_replace(raw, PATTERN, marks)).otherwise(F.regexp_replace(raw, KEYLESS, marks))
    hit = cut(read.filter("__hint").select("__row", F.split(marked, BEGIN, -1).alias("__parts"), F.monotonically_increasing_id().alias("__id")), "pii-rows")
    parts = F.slice("__parts", F.lit(2), F.size("__parts"))
    mentions = hit.filter(F.size("__parts") > 1).select("__id", F.posexplode(parts).alias("pos", "part"))
    found = F.substring_index(F.substring_index("part", END, 1), MIDDLE, -1)
    mentions = mentions.select("__id", "pos", found.alias("found"), kind_of(found, F.substring_index("part", MIDDLE, 1) != "").alias("kind"))
    mentions = cut(mentions.withColumn("normal", normal_of(F.col("found"), F.col("kind"))), "pii-named")
    mentions = mentions.join(hinted(cut(full_names(mentions), "pii-full")), ["__id", "normal"], "left")
    # a surname of a full name is that name's, and shown as its last word
    mentions = cut(mentions.select("__id", "pos", "found", "kind", F.coalesce("full", "normal").alias("normal"), F.col("full").isNotNull().alias("short")), "pii-mentions")
    entities, same = without_doctors(cut(mentions.select("kind", "normal").distinct(), "pii-entities"))
    given = assign_surrogates(entities, key)
    others = same.join(given.filter("kind = 'name'").withColumnRenamed("normal", "same"), "same").select("kind", "normal", "surrogate")
    given = hinted(cut(given.unionByName(others), "pii-surrogates"))
    shown = F.when(F.col("short"), F.concat(F.lit(":"), F.regexp_extract("surrogate", r"[^ :]*$", 0))).otherwise(F.col("surrogate"))
    new = dressed(F.col("found"), F.col("kind"), shown)
    untitled = F.when(F.col("kind") == "name", bare_name(F.col("found")))
    put = mentions.join(given, ["kind", "normal"]).select("__id", F.struct("pos", new.alias("new"), F.when(untitled.contains(" "), untitled).alias("name")).alias("put"))
    put = put.groupBy("__id").agg(F.sort_array(F.collect_list("put")).alias("__put"))
    after = F.transform(parts, lambda p: F.substring_index(p, END, -1))
    joined = F.concat(F.element_at("__parts", 1), F.array_join(F.zip_with(after, F.col("__put"), lambda p, x: F.concat(x["new"], p)), ""))
    plain = reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), _named(joined, F.col("__put")))
    changed = hit.join(put, "__id", "left").select(
        "__row", (F.size("__parts") - 1).alias("__n"), F.when(F.size("__parts") > 1, plain).otherwise(F.col(f"__row.`{text_col}`")).alias("__text")
    )
    told = clean.unionByName(changed)
    kept = [F.col("__text").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in own if c != "n_entities"]
    return told.select(*kept, F.col("__n").alias("n_entities"))


def _named(text: Column, put: Column) -> Column:
    """``text`` with names of several words replaced where they stand without a title, too."""
    names = F.array_distinct(F.transform(F.filter(put, lambda x: x["name"].isNotNull()), lambda x: F.struct(x["name"].alias("name"), bare_name(x["new"]).alias("new"))))

    def one(t: Column, x: Column) -> Column:
        spaced = F.replace(x["name"], F.lit(" "), F.lit(rf"\E{GAP}\Q"))
        found = F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), spaced, F.lit(r"\E(?![\p{L}\p{N}])")), x["new"])
        return F.when(t.contains(F.substring_index(x["name"], " ", 1)), found).otherwise(t)

    return F.when(F.size(names) > 0, F.aggregate(names, text, one)).otherwise(text)
