"""The surrogates once more, in plain Python and one mention at a time."""

import hashlib

import regex

from ledgerloom.llm import pii

KINDS = list(pii.PATTERNS)
ANY = regex.compile(pii.ANY)
WHOLE = {k: regex.compile(rf"\A(?:{p})\Z") for k, p in pii.PATTERNS.items()}


def kind_of(entity):
    return next((k for k in KINDS if k != "value" and WHOLE[k].search(entity)), "value")


LEAD = regex.compile(pii.LEAD)


def name_parts(entity):
    """(title, initials, words)"""
    lead = LEAD.match(entity)[0]
    title = regex.match(rf"(?:{pii.TITLES_M}|{pii.TITLES_F}|{pii.TITLES_N})\.? ", lead)[0]
    return title, lead[len(title) :], entity[len(lead) :].split(" ")


def canonical(kind, entity):
    if kind in pii.GIVEN_KIND:
        word = name_parts(entity)[2][-1].replace("’", "'").lower()
        if word[-3:] in ("ова", "ева", "ёва", "ина", "ына"):
            return word[:-1]
        return word[:-2] + "ий" if word[-4:] in ("ская", "цкая") else word
    if kind == "ipv6":
        return entity.lower()
    if kind == "email":
        return entity.lstrip("._%+-").lower()
    if kind in ("value", "ip"):
        return entity.lower() if kind == "value" else entity
    return "".join(c for c in entity if c.isalnum()).lower()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total


def draw(kind, canon, n, key):
    seed = hashlib.sha256(f"{key}|{kind}|{canon}|{n}".encode()).hexdigest()
    blocks = [hashlib.sha256(f"{seed}|{b}".encode()).hexdigest() for b in range(len(canon) // 32 + 2)]
    byte = lambda i: int("".join(blocks)[2 * i : 2 * i + 2], 16)
    wider = n // pii.WIDEN

    def pick(choices, i):
        return choices[byte(i) % len(choices)]

    def other(c, i):
        for choices, is_one in (
            ("0123456789", c in "0123456789"),
            (pii.CYRILLIC, regex.match(r"\p{Cyrillic}", c)),
            (pii.GREEK, regex.match(r"\p{Greek}", c)),
            (pii.LATIN, regex.match(r"\p{L}", c)),
        ):
            if is_one:
                return pick(choices, i)
        return c

    def fresh(text):
        return "".join(other(c, i) for i, c in enumerate(text))

    def more(choices):
        return "".join(pick(choices, len(canon) + i) for i in range(1, wider + 1))

    if kind == "ip":
        octets = []
        for i, o in enumerate(canon.split(".")):
            low, span = (1, 254) if wider else {3: (100, 155), 2: (10, 90)}.get(len(o), (1, 9))
            octets.append(str(low + byte(i) % span))
        return ".".join(octets)
    script = "cyrillic" if regex.search(r"\p{Cyrillic}", canon) else "latin"
    if kind in ("surname", *pii.GIVEN_KIND.values()):
        if kind.endswith("given") and n == 0:
            return pick(pii.GIVEN[script, kind.split()[0]], 0).lower()
        endings = pii.ENDINGS_CYRILLIC if script == "cyrillic" else pii.ENDINGS
        return "".join(pick(pii.SYLLABLES[script], i + 2) for i in range(3 + wider)) + pick(endings[kind], 1)
    if kind == "email":
        dot = canon.rindex(".")
        return more(pii.LATIN) + fresh(canon[:dot]) + canon[dot:]
    if kind in ("value", "secret"):
        if kind == "secret" and regex.fullmatch("[0-9a-f]+", canon):
            return "".join(blocks)[: len(canon) + wider]
        prefix = regex.match("akia|gh[pousr]|sk|xox[abp]|", canon)[0] if kind == "secret" else ""
        return prefix + fresh(canon)[len(prefix) :] + more(pii.LATIN)
    if kind == "ipv6":
        hexed = "0123456789abcdef"
        return "".join(c if c == ":" else pick(hexed, i) for i, c in enumerate(canon)) + more(hexed)
    number = fresh(canon) + more("0123456789")
    if kind == "card" and luhn(canon) % 10 == 0:
        return number[:-1] + str(-luhn(number[:-1] + "0") % 10)
    if kind == "phone" and (len(canon) > 10 or canon[0] == "0"):
        return canon[0] + number[1:]
    if kind == "iban":
        rest = number[4:]
        left = int("".join(str(int(c, 36)) for c in rest + canon[:2] + "00")) % 97
        return f"{canon[:2]}{98 - left:02}{rest}"
    if kind == "ssn":
        area = int(number[:3]) % 898 + 1
        return f"{area + (area >= 666):03}{int(number[3:5]) % 99 + 1:02}{int(number[5:9]) % 9999 + 1:04}{number[9:]}"
    return number


def assign(entities, key):
    """The surrogate of every (kind, canon)."""
    now = {e: (0, draw(*e, 0, key)) for e in entities}
    while True:
        groups = {}
        for (kind, canon), (n, s) in now.items():
            groups.setdefault((kind, s), []).append((n, canon))
        again = []
        for (kind, s), owners in groups.items():
            real = (kind, s) in now
            again += [(kind, c) for _, c in owners if real or c != min(owners)[1]]
        if not again:
            return {e: s for e, (_, s) in now.items()}
        for e in again:
            n = now[e][0] + 1
            now[e] = (n, draw(*e, n, key))


def dress(kind, entity, surrogate, given, key):
    if kind in pii.GIVEN_KIND:
        title, initials, words = name_parts(entity)
        step = 1 + int(hashlib.sha256(key.encode()).hexdigest(), 16) % 20

        def turn(c):
            alphabet = next((a.upper() for a in (pii.LATIN, pii.CYRILLIC, pii.GREEK) if c in a.upper()), c)
            return alphabet[(alphabet.index(c) + step) % len(alphabet)]

        def word(old, new):
            return new.upper() if regex.search(r"\p{Lu}{2}\Z", old) else new[:1].upper() + new[1:]

        if kind == "female" and regex.search(r"\p{Cyrillic}\Z", surrogate):
            surrogate += "а"
        first = word(words[0], given) + " " if given else ""
        return title + "".join(map(turn, initials)) + first + word(words[-1], surrogate)
    if kind == "ipv6":
        return surrogate.upper() if regex.search("[A-F]", entity) else surrogate
    if kind == "ip":
        return surrogate
    if kind in ("email", "value"):
        core = entity.lstrip("._%+-") if kind == "email" else entity
        lead = entity[: len(entity) - len(core)]
        extra = len(surrogate) - len(core) if kind == "email" else 0
        body = surrogate[extra:]
        cased = "".join(n.upper() if i < len(core) and regex.match(r"\p{Lu}", core[i]) else n for i, n in enumerate(body))
        return lead + surrogate[:extra] + cased
    capitals = not regex.search(r"\p{Ll}", entity)
    left, out = list(surrogate), []
    for c in entity:
        if not c.isalnum():
            out.append(c)
        elif left:
            n = left.pop(0)
            out.append(n.upper() if capitals or regex.match(r"\p{Lu}", c) else n)
    return "".join(out) + "".join(n.upper() if capitals else n for n in left)


def replace(rows, key):
    """{doc_id: (text, n_entities)}"""

    def entities_of(entity):
        """(kind of mention, the entity, that of its given name or None)"""
        kind = kind_of(entity)
        words = name_parts(entity)[2] if kind in pii.GIVEN_KIND else []
        given = (pii.GIVEN_KIND[kind], words[0].replace("’", "'").lower()) if len(words) > 1 else None
        return kind, ("surname" if words else kind, canonical(kind, entity)), given

    entities = {e for _, text in rows for m in ANY.finditer(text or "") for e in entities_of(m[0])[1:] if e}
    chosen = assign(entities, key)

    def new(m):
        kind, whole, given = entities_of(m[0])
        return dress(kind, m[0], chosen[whole], chosen.get(given), key)

    return {i: (None, 0) if t is None else ANY.subn(new, t) for i, t in rows}
