"""Personal data and secrets replaced by surrogates.

Entities are found by one pattern.  A surrogate is of the entity's type and
keeps its format: letters stay letters of the same script and case, digits
stay digits, punctuation stays; card numbers keep a valid check digit, account
numbers (IBAN) their country and valid check digits, addresses of machines keep
octets in range, hexadecimal secrets stay hexadecimal and others keep the prefix
that names their kind, social security numbers keep to the ranges in use, mail
addresses keep their last label, telephone numbers the first digit of a country
code or the 0 of a national one, and titled names keep title, gender, script,
capitals and initials as such.

Coreference: surrogates belong to canonical entities (case and separators
removed), so the same entity gets the same surrogate wherever and however it is
written.  Distinctness: the surrogates of all canonical entities are compared;
one that two entities share, or that is itself an entity of the corpus, is
drawn again for all but the least of them, until none collides.  Draws that
collide again and again widen within the format: longer names, addresses with
octets of other lengths, longer mail names, numbers and secrets.  Surnames and
given names of titled names are entities each, so two people get one name only
where they have one, and a family keeps one name whatever its titles: a Cyrillic
surname and its feminine form share a stem.

The key comes from the caller; the same key gives the same surrogates.

Only entities move between machines, and only the rows of texts that hold any.

Patterns and surrogates take time in proportion to a text's length, also where
it is one run of letters, digits or labels.  A word of more than 60 letters
after a title is no name.

Defined cases: a null text stays null; texts without entities stay as they
are; repeated rows get the same surrogates; other columns are kept; an empty
table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, keyed_join, stored

#: Patterns of the entity types, most specific first (Java syntax).
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
TITLES_M = r"(?:Mr|MR|Herr|Monsieur|Señor|Sr|Господин|[Гг]-н)"
TITLES_F = r"(?:Mrs|MRS|Ms|MS|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|[Гг]-жа)"
TITLES_N = r"(?:Prof(?:essor)?\.? Dr|Prof(?:essor)?|Doctor|Dr)"
NAME = r"(?:\p{Lu}(?:\p{Ll}|\p{Lu}(?=\p{Ll})|['’-](?=\p{L})\p{Lu}?){1,60}|\p{Lu}[\p{Lu}'’-]{0,60}\p{Lu})(?!\p{L})"
#: Initials before a name.
INITIALS = r"(?:\p{Lu}\. ?){0,4}"
#: What names a secret, up to the value or its quote; the value may stand without quotes, but a titled name is no value.
NAMED = r"(?i:token|secret|password|api[_ -]?key)[\"']?[ ]{0,2}[=:][ ]{0,2}"
PATTERNS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9][A-Za-z0-9.-]*(?<=\.[A-Za-z]{2,63})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,6}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])(?<=[A-Z0-9 ]{15,40})",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[abp]-[A-Za-z0-9-]{10,})(?![0-9A-Za-z])",
    "value": rf"(?<=[=: \"'])(?<={NAMED}[\"']?)(?:(?<=[\"'])[^\"'\s]{{6,}}(?=[\"'])|(?<![\"'])(?!(?:{TITLES_M}|{TITLES_F}|{TITLES_N})\.? \p{{Lu}})[^\"'\s]{{5,}}[^\"'\s.,;:)\]}}>])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*\d)(?=[0-9A-Fa-f:]{0,39}::|(?:[0-9A-Fa-f]{1,4}:){7})(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+(?=(?:[ .()-]{0,2}\d){7})\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{1,4}){1,4}[ .-]?\d{2,4}(?!\d)|(?<![\d+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])|(?<![\d+(.-])0\d{2,4}[ -]\d{3,4}[ -]?\d{3,4}(?![ -]?\d)",
    "card": r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})(?!\d)",
    "male": rf"(?<!\p{{L}}){TITLES_M}\.? {INITIALS}{NAME}(?: {NAME})?",
    "female": rf"(?<!\p{{L}}){TITLES_F}\.? {INITIALS}{NAME}(?: {NAME})?",
    "titled": rf"(?<!\p{{L}}){TITLES_N}\.? {INITIALS}{NAME}(?: {NAME})?",
}
#: Title and initials of a titled name.
LEAD = rf"\A(?:{TITLES_M}|{TITLES_F}|{TITLES_N})\.? {INITIALS}(?=\p{{Lu}})"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Alphabets by script; a letter is drawn from its own.
LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
#: Syllables of surrogate names by script, and endings by script and gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ka ke la le lo ma me mo na ne no pa pe ra re ro sa se ta te to va ve".split(),
    "cyrillic": "ба бе бо ва ве да де до ка ке ла ле ло ма ме мо на не но па пе ра ре ро са се та те то".split(),
}
ENDINGS = {
    "surname": "rd son ll nt".split(),
    "male given": "us o el an".split(),
    "female given": "a ia ina elle".split(),
    "titled given": "y is ey ie".split(),
}
#: Surnames are drawn in their masculine form, whose feminine one ends with an а more.
ENDINGS_CYRILLIC = {
    "surname": ["ров", "нов", "лин"],
    "male given": ["ан", "ор", "ис"],
    "female given": ["ана", "ора", "иса"],
    "titled given": ["ня", "ша", "ля"],
}
GIVEN = {
    ("latin", "male"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Max Noel Oscar Paul".split(),
    ("latin", "female"): "Anna Berta Clara Diana Emma Flora Greta Helena Ida Julia Karla Lena Maria Nora Olga Paula".split(),
    ("latin", "titled"): "Alex Chris Dana Eli Jo Kim Lou Nicola Pat Quinn Robin Sam Sascha Toni Val Yuri".split(),
    ("cyrillic", "titled"): "Валя Женя Паша Саша Слава Шура".split(),
    ("cyrillic", "male"): "Антон Борис Виктор Глеб Денис Иван Карл Лев Марк Олег Павел Роман".split(),
    ("cyrillic", "female"): "Анна Белла Вера Галина Дина Елена Зоя Инна Лидия Мария Нина Ольга".split(),
}
#: Given names are entities of their own kinds.
GIVEN_KIND = {"male": "male given", "female": "female given", "titled": "titled given"}
#: Prefixes of secrets that name their kind, without marks.
PREFIX = r"\A(?:akia|gh[pousr]|sk|xox[abp])"
#: Cyrillic surnames in their feminine form, and what the masculine one has in place of the end.
FEMININE = ((r"(?<=[оеё]в|[иы]н)а\z", ""), (r"(?<=[сц]к)ая\z", "ий"))
#: Draws after which the next ones are from a wider space of the same format.
WIDEN = 8
#: More rounds than widening draws need; beyond, a format of fixed size is exhausted.
MOST_DRAWS = 200


def _first_type(entity: Column) -> Column:
    """The type of a match: the first whose pattern fits it whole ('value' needs context, so it is what is left)."""
    out = F.lit("value")
    for name, pattern in reversed([(n, p) for n, p in PATTERNS.items() if n != "value"]):
        out = F.when(entity.rlike(rf"\A(?:{pattern})\z"), F.lit(name)).otherwise(out)
    return out


def _part(word: Column) -> Column:
    """The canonical form of a surname or given name."""
    return F.lower(F.translate(word, "’", "'"))


def _names(entity: Column) -> Column:
    """The words of a titled name without title and initials."""
    return F.split(F.regexp_replace(entity, LEAD, ""), " ")


def canonical(kind: Column, entity: Column) -> Column:
    """What coreferent mentions share; of names the surname in its masculine form."""
    surname = _part(F.element_at(_names(entity), -1))
    for ending, masculine in FEMININE:
        surname = F.regexp_replace(surname, ending, masculine)
    bare = F.lower(F.regexp_replace(entity, r"[^\p{L}\p{N}]", ""))
    return (
        F.when(kind.isin(*GIVEN_KIND), surname)
        .when(kind == "email", F.lower(F.regexp_replace(entity, r"\A[._%+-]+", "")))
        .when(kind.isin("value", "ipv6"), F.lower(entity))
        .when(kind == "ip", entity)  # octets are what is drawn
        .otherwise(bare)
    )


def given_name(kind: Column, entity: Column) -> Column:
    """The canonical given name of a titled name, null where it has none."""
    words = _names(entity)
    return F.when(kind.isin(*GIVEN_KIND) & (F.size(words) > 1), _part(F.get(words, 0)))


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, th, pos, entity, form, kind, canon of every match in every text, in the order of the text.

    ``form`` is the pattern; ``kind`` the kind of entity, which is one for the surnames of all forms of names.
    """
    rows = documents(docs).filter(F.col("text").rlike(ANY))
    found = rows.select(
        "doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("pos", "entity")
    )
    typed = found.withColumn("form", _first_type(F.col("entity")))
    kind = F.when(F.col("form").isin(*GIVEN_KIND), "surname").otherwise(F.col("form"))
    return typed.withColumns({"kind": kind, "canon": canonical(F.col("form"), F.col("entity"))})


def _noise(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    """Blocks of 64 hex digits of a keyed hash, enough for two digits a character and some more."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, draw.cast("string")), 256)  # the entity is read once
    blocks = F.sequence(F.lit(0), F.floor(F.length(canon) / 32).cast("int") + 1)
    return let(seed, lambda z: F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", z, b.cast("string")), 256)))


def _number(noise: Column, i: Column) -> Column:
    """The i-th byte of the noise."""
    return F.conv(F.substr(F.get(noise, F.floor(i / 32).cast("int")), 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int")


def _pick(choices: str | list[str], n: Column) -> Column:
    if isinstance(choices, str):
        return F.substr(F.lit(choices), F.pmod(n, F.lit(len(choices))) + 1, F.lit(1))
    return F.get(F.lit(choices), F.pmod(n, F.lit(len(choices))))


def _same_class(c: Column, n: Column) -> Column:
    """A character of the class and script of ``c``; others stay."""
    return (
        F.when(c.rlike(r"\A[0-9]\z"), _pick("0123456789", n))
        .when(c.rlike(r"\A\p{IsCyrillic}\z"), _pick(CYRILLIC, n))
        .when(c.rlike(r"\A\p{IsGreek}\z"), _pick(GREEK, n))
        .when(c.rlike(r"\A\p{L}\z"), _pick(LATIN, n))
        .otherwise(c)
    )


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits whose last is not doubled."""
    chars = F.reverse(F.split(digits, ""))

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(chars, worth), F.lit(0), lambda a, x: a + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def draw_surrogate(kind: Column, canon: Column, draw: Column, key: str) -> Column:
    """The canonical surrogate of a canonical entity at the given draw."""
    wider = F.floor(draw / WIDEN).cast("int")

    def drawn(z: Column) -> Column:
        letters = F.split(canon, "")

        def redrawn(chars: Column) -> Column:
            return F.array_join(F.transform(chars, lambda c, i: _same_class(c, _number(z, i))), "")

        def more(choices: str) -> Column:
            """Further characters of draws that widen."""
            extra = F.transform(F.sequence(F.lit(0), wider), lambda i: F.when(i > 0, _pick(choices, _number(z, F.length(canon) + i))).otherwise(""))
            return F.array_join(extra, "")

        dot = F.length(canon) - F.locate(".", F.reverse(canon)) + 1  # the last
        email = F.concat(more(LATIN), redrawn(F.slice(letters, 1, dot - 1)), F.substr(canon, dot))

        def checked(plain: Column) -> Column:
            head = F.substr(plain, F.lit(1), F.length(plain) - 1)
            return F.concat(head, F.pmod(-_luhn_sum(F.concat(head, F.lit("0"))), F.lit(10)).cast("string"))

        number = F.concat(redrawn(letters), more("0123456789"))
        card = F.when(_luhn_sum(canon) % 10 == 0, let(number, checked)).otherwise(number)
        script = F.when(canon.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))

        def name(s: str, role: str) -> Column:
            body = F.transform(F.sequence(F.lit(0), 2 + wider), lambda i: _pick(SYLLABLES[s], _number(z, i + 2)))
            endings = ENDINGS_CYRILLIC if s == "cyrillic" else ENDINGS
            return F.concat(F.array_join(body, ""), _pick(endings[role], _number(z, F.lit(1))))

        def account(plain: Column) -> Column:
            """Country, check digits by the remainder of 97, and the rest as drawn."""
            country, rest = F.substr(canon, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
            digits = F.split(F.concat(rest, country, F.lit("00")), "")
            left = F.aggregate(digits, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 87) % 97))
            return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), rest)

        def security(plain: Column) -> Column:
            """Areas 001 to 899 but for 666, groups from 01, serials from 0001 on."""
            area, group, serial = (F.substr(plain, F.lit(at), F.lit(n)).cast("int") for at, n in ((1, 3), (4, 2), (6, 4)))
            area = area % 898 + 1
            area = F.when(area >= 666, area + 1).otherwise(area)
            parts = [F.lpad(x.cast("string"), n, "0") for x, n in ((area, 3), (group % 99 + 1, 2), (serial % 9999 + 1, 4))]
            return F.concat(*parts, F.substr(plain, F.lit(10)))

        hexed = F.substr(F.array_join(z, ""), F.lit(1), F.length(canon) + wider)
        hex_only = (kind == "secret") & canon.rlike(r"\A[0-9a-f]+\z")
        groups = F.transform(letters, lambda c, i: F.when(c == ":", c).otherwise(_pick("0123456789abcdef", _number(z, i))))
        address = F.concat(F.array_join(groups, ""), more("0123456789abcdef"))
        first_stays = (kind == "phone") & ((F.length(canon) > 10) | F.startswith(canon, F.lit("0")))  # of a country code, or a national 0
        phone = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(number, F.lit(2)))
        prefix = F.when(kind == "secret", F.regexp_extract(canon, PREFIX, 0)).otherwise("")
        secret = F.concat(prefix, F.substr(redrawn(letters), F.length(prefix) + 1), more(LATIN))
        out = F.when(kind == "email", email).when(kind == "card", card).when(hex_only, hexed).when(first_stays, phone)
        out = out.when(kind == "iban", let(number, account)).when(kind == "ssn", let(number, security)).when(kind == "ipv6", address)
        for s in SYLLABLES:
            out = out.when((kind == "surname") & (script == s), name(s, "surname"))
            for gender, given in GIVEN_KIND.items():
                # The names known by heart serve for the first draw; those that collide or are real are made of syllables.
                first = F.lower(_pick(GIVEN[s, gender], _number(z, F.lit(0))))
                out = out.when((kind == given) & (script == s), F.when(draw == 0, first).otherwise(name(s, given)))
        return out.when(kind.isin("value", "secret"), secret).otherwise(number)

    return let(_noise(key, kind, canon, draw), drawn)


def _ip_surrogate(entity: Column, key: str, draw: Column) -> Column:
    """An address in range whose octets have as many digits as those of ``entity``; draws that widen take any octets."""

    def of_noise(noise: Column) -> Column:
        def octet(o: Column, i: Column) -> Column:
            n = _number(noise, i)
            return F.when(draw >= WIDEN, 1 + n % 254).when(F.length(o) == 3, 100 + n % 155).when(F.length(o) == 2, 10 + n % 90).otherwise(1 + n % 9)

        return F.array_join(F.transform(F.split(entity, r"\."), lambda o, i: octet(o, i).cast("string")), ".")

    return let(_noise(key, F.lit("ip"), entity, draw), of_noise)


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``entities``: stored, unique (kind, canon).  Adds ``surrogate``, distinct within a kind and no entity of it.

    Collisions are settled in rounds; each looks at the entities that still collide and at all that are settled.
    """

    def draw(df: DataFrame) -> DataFrame:
        made = F.when(F.col("kind") == "ip", _ip_surrogate(F.col("canon"), key, F.col("draw"))).otherwise(
            draw_surrogate(F.col("kind"), F.col("canon"), F.col("draw"), key)
        )
        return df.withColumn("surrogate", made)

    now = stored(draw(entities.withColumn("draw", F.lit(0))), "surrogates")
    for _ in range(MOST_DRAWS):
        # The least entity of those that share a surrogate keeps it, unless it is a real entity.
        shared = now.groupBy("kind", "surrogate").agg(F.min(F.struct("draw", "canon")).alias("owner"), F.count(F.lit(1)).alias("n"))
        real = entities.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        bad = shared.join(real, ["kind", "surrogate"], "left").filter((F.col("n") > 1) | F.col("real"))
        bad = stored(bad, "surrogate-collisions")
        if not bad.limit(1).count():
            return now.select("kind", "canon", "surrogate")
        checked = now.join(bad, ["kind", "surrogate"], "left")
        loses = F.col("n").isNotNull() & (F.col("real").isNotNull() | (F.col("owner")["canon"] != F.col("canon")))
        stay = checked.filter(~loses).select("kind", "canon", "draw", "surrogate", *[c for c in entities.columns if c not in ("kind", "canon")])
        again = checked.filter(loses).select(*entities.columns, (F.col("draw") + 1).alias("draw"))
        now = stored(stay.unionByName(draw(again)), "surrogates")
    kinds = sorted(r["kind"] for r in bad.select("kind").distinct().collect())  # as many as there are patterns, at most
    raise RuntimeError(f"no surrogates of the format are left: {', '.join(kinds)}")


def _turned(key: str) -> tuple[str, str]:
    """Capitals, and those that stand for them as initials: each alphabet turned by a step that the key tells."""
    step = 1 + int(hashlib.sha256(key.encode()).hexdigest(), 16) % 20
    alphabets = [a.upper() for a in (LATIN, CYRILLIC, GREEK)]
    return "".join(alphabets), "".join(a[step:] + a[:step] for a in alphabets)


def _dress(form: Column, entity: Column, surrogate: Column, given: Column, key: str) -> Column:
    """The surrogate in the format of the mention; ``given`` is that of its given name, null without one."""

    def spread(bound: Column) -> Column:
        """Letters and digits take the surrogate's characters in turn, the rest stays; what is left over follows."""
        chars, new, capitals = bound["chars"], bound["new"], bound["capitals"]

        def cased(old: Column, c: Column) -> Column:
            # Digits may become letters, whose case is that of the whole.
            return F.when(capitals | old.rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)

        places = F.transform(chars, lambda c, i: F.struct(i.alias("at"), c.alias("c")))
        stay = F.filter(places, lambda x: ~x["c"].rlike(r"[\p{L}\p{N}]"))
        taken = F.filter(places, lambda x: x["c"].rlike(r"[\p{L}\p{N}]"))
        fresh = F.transform(F.arrays_zip(taken.alias("old"), new.alias("new")), lambda x: F.struct(F.coalesce(x["old"]["at"], F.size(chars)).alias("at"), cased(F.coalesce(x["old"]["c"], F.lit("")), x["new"]).alias("c")))
        ends = F.filter(fresh, lambda x: x["at"] == F.size(chars))
        put = F.array_sort(F.concat(stay, F.filter(fresh, lambda x: x["at"] < F.size(chars))))
        return F.array_join(F.transform(F.concat(put, ends), lambda x: x["c"]), "")

    def same_place(chars: Column, new: Column) -> Column:
        """The surrogate's characters in the case of the mention's."""
        pairs = F.arrays_zip(chars.alias("old"), new.alias("new"))
        return F.array_join(F.transform(pairs, lambda x: F.when(F.coalesce(x["old"], F.lit("")).rlike(r"\p{Lu}"), F.upper(x["new"])).otherwise(x["new"])), "")

    def as_word(old: Column, new: Column) -> Column:
        return F.when(old.rlike(r"\p{Lu}{2}\z"), F.upper(new)).otherwise(F.initcap(new))

    words = _names(entity)
    last = F.element_at(words, -1)
    title = F.regexp_extract(entity, rf"\A(?:{TITLES_M}|{TITLES_F}|{TITLES_N})\.? ", 0)
    initials = F.substr(F.regexp_extract(entity, LEAD, 0), F.length(title) + 1)
    feminine = (form == "female") & surrogate.rlike(r"\p{IsCyrillic}\z")
    surname = F.concat(surrogate, F.when(feminine, "а").otherwise(""))
    name = F.concat(title, F.translate(initials, *_turned(key)), F.when(given.isNotNull(), F.concat(as_word(F.get(words, 0), given), F.lit(" "))).otherwise(""), as_word(last, surname))
    lead = F.regexp_extract(entity, r"\A[._%+-]*", 0)  # of a mail address
    address = F.substr(entity, F.length(lead) + 1)
    wider = F.length(surrogate) - F.length(address)
    mail = F.concat(lead, F.substr(surrogate, F.lit(1), wider), same_place(F.split(address, ""), F.split(F.substr(surrogate, wider + 1), "")))
    bound = F.struct(F.split(entity, "").alias("chars"), F.split(surrogate, "").alias("new"), (~entity.rlike(r"\p{Ll}")).alias("capitals"))
    return (
        F.when(form.isin(*GIVEN_KIND), name)
        .when(form == "ip", surrogate)
        .when(form == "ipv6", F.when(entity.rlike("[A-F]"), F.upper(surrogate)).otherwise(surrogate))
        .when(form == "email", mail)
        .when(form == "value", same_place(F.split(entity, ""), F.split(surrogate, "")))
        .when(entity.rlike(r"\A[\p{Ll}\p{N}]+\z") & entity.rlike(r"\p{Ll}"), surrogate)
        .otherwise(let(bound, spread))
    )


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its own columns and surrogates in ``text``; ``n_entities`` is added under that name."""
    columns = docs.columns
    found = mentions(docs)
    given_kind = F.concat("form", F.lit(" given"))
    found = found.withColumn("given", given_name(F.col("form"), F.col("entity")))
    found = stored(found.withColumn("given_kind", F.when(F.col("given").isNotNull(), given_kind)), "pii-mentions")
    titled = found.filter("given IS NOT NULL")
    named = found.select("kind", "canon").unionByName(titled.select(F.col("given_kind").alias("kind"), F.col("given").alias("canon")))
    entities = stored(named.groupBy("kind", "canon").agg(F.count(F.lit(1)).alias("n")), "pii-entities")
    chosen = stored(
        assign_surrogates(entities.select("kind", "canon"), key).join(entities, ["kind", "canon"]), "pii-chosen"
    )
    total = found.count()
    placed = keyed_join(found, chosen, ["kind", "canon"], "n", total).drop("n")
    placed = stored(placed, "pii-placed")
    of_given = chosen.select(F.col("kind").alias("given_kind"), F.col("canon").alias("given"), F.col("surrogate").alias("given_surrogate"), "n")
    full = keyed_join(placed.filter("given IS NOT NULL"), of_given, ["given_kind", "given"], "n", total).drop("n")
    bare = placed.filter("given IS NULL").withColumn("given_surrogate", F.lit(None).cast("string"))
    placed = bare.unionByName(full.select(*bare.columns))
    dressed = placed.select(
        "doc_id", "th", "pos", _dress(F.col("form"), F.col("entity"), F.col("surrogate"), F.col("given_surrogate"), key).alias("new")
    )
    # Rows that repeat id and text find the same entities: one list serves them all.
    lists = dressed.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("pos", "new"))).alias("news"))
    lists = stored(lists, "pii-lists").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("news.new").alias("__new"))
    rows = docs.withColumn("__hash", F.xxhash64(docs["text"].cast("string")))
    text = rows["text"].cast("string")
    same = rows["doc_id"].cast("long").eqNullSafe(lists["__id"]) & (rows["__hash"] == lists["__th"])
    # Texts meet their lists by sorting at every size; the lists grow with the input and are not broadcast.
    joined = rows.join(lists.hint("merge"), same, "left")
    gaps = F.split(text, ANY, -1)
    rebuilt = F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), F.col("__new").alias("new")), lambda x: F.concat(x["gap"], F.coalesce(x["new"], F.lit("")))), "")
    changed = F.when(F.col("__new").isNull(), text).otherwise(rebuilt).alias("text")
    kept = [changed if c == "text" else rows[f"`{c}`"] for c in columns if c != "n_entities"]
    return joined.select(*kept, F.coalesce(F.size("__new"), F.lit(0)).cast("long").alias("n_entities"))


def keep_private(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its own columns only, with surrogates in ``text``."""
    out = replace_entities(docs, key)
    return out.select(*[f"`{c}`" for c in docs.columns if c in out.columns])
