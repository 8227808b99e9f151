"""Operator 8: surrogates for personal data.

Detected entities (e-mail addresses, telephone numbers, IPv4 addresses, payment
cards, IBANs, US social security numbers, access keys, password and token
values, and names) are replaced by keyed surrogates of their
type.  A surrogate keeps length, punctuation, case and script: a digit becomes a
digit, a letter a letter of its alphabet; octets stay octets, card numbers and
IBANs keep valid check digits, names come from lists of the name's
gender and script.  It is a function of the key, the type and the entity's
canonical form alone, so all mentions in all documents change alike without
any exchange between tasks.

A name is what follows a title, or a known first name with a surname.  Where a document has one full name
of a surname, the surname alone, with or without a title, is that person, and so is the full name
without a title.  A name of neither known gender draws from the lists of both.

Distinctness is checked over the whole corpus: distinct entities are gathered
once (combined before the shuffle), and where two share a surrogate, or a surrogate is
itself an entity of the corpus, all but the smallest get further attempts until none is left.
Later attempts draw from ever larger domains (one more surname or character), so this ends.
Only these exceptions, with the documents that mention them, form a table that joins the documents;
Spark broadcasts it while it is small.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm._shared import dropped, lean, small_batches, stored

#: From this attempt on a surrogate is longer than its entity, by one character more each time.
SAME_LENGTH_ATTEMPTS = 8

# First names by gender and script, surnames by script, and titles by gender.
NAMES = {
    ("m", "latin"): ["Adrian", "Bernard", "Conrad", "Damian", "Edgar", "Felix", "Gregor", "Hugo", "Ivan", "Julian", "Konstantin", "Lorenz", "Martin", "Norbert", "Oscar", "Patrick", "Quentin", "Roland", "Stefan", "Tobias", "Ulrich", "Victor", "Walter", "Xavier", "Yannick", "Zacharias"],
    ("f", "latin"): ["Agnes", "Beatrice", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Katharina", "Laura", "Martha", "Nina", "Olivia", "Paula", "Queenie", "Rosa", "Sofia", "Teresa", "Ursula", "Vera", "Wilma", "Xenia", "Yvonne", "Zoe"],
    ("m", "cyrillic"): ["Андрей", "Борис", "Виктор", "Григорий", "Дмитрий", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Николай", "Олег", "Павел", "Роман", "Сергей", "Тимофей"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Ксения", "Лариса", "Мария", "Наталья", "Ольга", "Полина", "Софья", "Татьяна", "Юлия"],
}
SURNAMES = {
    "latin": ["Ashford", "Brennan", "Castell", "Dorner", "Ellwood", "Fairley", "Gardiner", "Hartmann", "Ibanez", "Jansen", "Keller", "Lambert", "Moreau", "Nordin", "Ortega", "Palmer", "Quigley", "Renard", "Sander", "Tremblay", "Ullmann", "Vasquez", "Winter", "Xander", "Young", "Zeller"],
    "cyrillic": ["Белов", "Волков", "Громов", "Дорохов", "Ершов", "Жуков", "Зимин", "Климов", "Лебедев", "Миронов", "Носов", "Орлов", "Панов", "Рябов", "Соколов", "Титов"],
}
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Don", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Doña", "Госпожа"],
    "n": ["Dr", "Prof", "Professor", "Doctor", "Doktor", "Docteur", "Доктор", "Профессор"],
}
#: More first names by gender, to know persons without a title by (fixed values).
FIRST_NAMES = {
    "m": ["Alexander", "Andrew", "Anthony", "Antonio", "Benjamin", "Carlos", "Charles", "Christopher", "Daniel", "David", "Edward", "Francisco", "Frank", "George", "Hans", "Henry", "Jacques", "James", "Javier", "Jean", "Johann", "John", "Jonathan", "Jorge", "Joseph", "Juan", "Jürgen", "Karl", "Kevin", "Klaus", "Luis", "Manuel", "Matthew", "Michael", "Miguel", "Nicholas", "Pablo", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Richard", "Robert", "Samuel", "Steven", "Thomas", "Timothy", "William", "Wolfgang"],
    "f": ["Alice", "Amanda", "Andrea", "Angela", "Anna", "Anne", "Barbara", "Carmen", "Caroline", "Catherine", "Charlotte", "Christine", "Claudia", "Dorothy", "Elisabeth", "Elizabeth", "Emily", "Emma", "Françoise", "Hannah", "Ingrid", "Isabel", "Jane", "Jennifer", "Jessica", "Karen", "Laura", "Linda", "Lucia", "Margaret", "Maria", "Marie", "Mary", "Michelle", "Monika", "Nancy", "Nathalie", "Pilar", "Rebecca", "Sabine", "Sandra", "Sarah", "Sophie", "Susan", "Sylvie", "Ann", "Teresa", "Ursula", "Valerie", "Victoria"],
}

_ONE_NAME = "[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+"
_NAME = f"{_ONE_NAME}(?:-{_ONE_NAME})?"
_TITLE = "|".join(t for many in TITLES.values() for t in many)
#: What a secret follows, in any case; a suffix may come after it, as in secret_key.
_KEYWORD = "password|passwd|pwd|secret|token|api[_-]?key"
#: Entities by type; the group named like the type is what is replaced.
_PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9_][\w.+%-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<access_key>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)"
    r"|(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d))"
    r"|(?P<phone>(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-]|\.\d))"
    r"|(?P<ssn>(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-]|\.\d))"
    r"|(?P<ip>(?<![\w.+-])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w-]|\.\d))"
    rf"|(?:(?i:{_KEYWORD})(?:[_-][A-Za-z0-9]+)*\"?\s*[=:]\s*\"?(?P<secret>[A-Za-z0-9+/_-]{{8,}}))",
)
_QUICK = re.compile(rf"[0-9@]|(?i:{_KEYWORD})")
_TITLE_OF = {t: g for g, many in TITLES.items() for t in many}
_FIRST = {n: g for (g, _), many in NAMES.items() for n in many} | {n: g for g, many in FIRST_NAMES.items() for n in many}
_BY_TITLE = re.compile(rf"\b(?P<title>{_TITLE})\.? (?P<name>{_NAME}(?: {_NAME})?)")
_BY_NAME = re.compile(rf"\b({_ONE_NAME}) (?={_ONE_NAME})")
_FULL = re.compile(rf"{_NAME} {_NAME}\b")


def luhn(digits: str) -> bool:
    total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def names(text: str) -> list[tuple[int, int, str, str]]:
    """Mentions of persons; those of one person of a document share type and canonical form."""
    found: dict[int, tuple[int, str, str]] = {}  # by start: end, gender, name
    for m in _BY_TITLE.finditer(text):
        first = m["name"].split(" ")[0]
        gender = _TITLE_OF[m["title"]]
        found[m.start("name")] = (m.end("name"), _FIRST.get(first, "n") if gender == "n" else gender, m["name"])
    for m in _BY_NAME.finditer(text):
        full = _FULL.match(text, m.start()) if m[1] in _FIRST and m.start() not in found else None
        if full:
            found[m.start()] = (full.end(), _FIRST[m[1]], full[0])
    if not found:
        return []
    persons: dict[str, dict[str, str]] = {}  # full names and their gender by surname; a title's gender, coming first in the text, counts
    for _, gender, name in found.values():
        if " " in name:
            known = persons.setdefault(name.split(" ")[-1], {})
            known[name] = gender if known.get(name, "n") == "n" else known[name]
    one = {surname: next(iter(known.items())) for surname, known in persons.items() if len(known) == 1}
    bare = {name: (name, g) for known in persons.values() for name, g in known.items()} | {surname: person for surname, person in one.items()}
    out = []
    for start, (end, gender, name) in found.items():
        value, g = bare.get(name, (name, gender))
        out.append((start, end, "name_" + g, value))
    if bare:
        for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, sorted(bare, key=len, reverse=True)))})\b", text):
            value, g = bare[m[0]]
            out.append((m.start(), m.end(), "name_" + g, value))
    return out


def changeable(value: str) -> bool:
    """Whether a value has anything that a surrogate can change; rules and dashes stand for no secret."""
    return any(c.isascii() and c.isalnum() for c in value)


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of the entities of a text, in order and apart; of two that overlap the first, and of equal starts the longer."""
    found = []
    if _QUICK.search(text):
        for m in _PATTERN.finditer(text):
            kind = m.lastgroup
            value = m[kind]
            if kind == "card" and not 13 <= sum(map(str.isdigit, value)) <= 19:
                continue
            if kind == "iban" and not iban_valid(value):
                continue
            if kind == "secret" and not changeable(value):
                continue
            found.append((m.start(kind), m.end(kind), kind, canonical(kind, value)))
    persons = names(text)
    if persons:
        found = sorted(found + persons, key=lambda e: (e[0], -e[1]))
        apart, end = [], -1
        for e in found:
            if e[0] >= end:
                apart.append(e)
                end = e[1]
        found = apart
    return found


def canonical(kind: str, value: str) -> str:
    """What all mentions of one entity share."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "iban"):
        return re.sub("[ -]", "", value)
    if kind == "phone":
        return re.sub(r"[^\d+]", "", value)
    return value


GIVEN, SURNAME = "given_", "surname"
PARTS = (GIVEN, SURNAME)


def name_parts(kind: str, value: str) -> list[tuple[str, str]]:
    """What of an entity gets a surrogate of its own: a person's given names and surname apart, so that a surname has one surrogate with and without them."""
    if not kind.startswith("name_"):
        return [(kind, value)]
    given, _, surname = value.rpartition(" ")
    return ([(f"{GIVEN}{kind[-1]}", given)] if given else []) + [(SURNAME, surname)]


class Surrogates:
    """Keyed surrogates."""

    def __init__(self, key: bytes):
        self.key = key

    def _stream(self, *what: str) -> Iterator[int]:
        """Endless keyed bytes."""
        k = 0
        while True:
            yield from hmac.new(self.key, "\0".join([*what, str(k)]).encode(), hashlib.sha256).digest()
            k += 1

    @staticmethod
    def _below(stream: Iterator[int], n: int) -> int:
        return (next(stream) << 16 | next(stream) << 8 | next(stream)) % n

    def _like(self, text: str, stream: Iterator[int], alphabet: str = "") -> str:
        """Digits for digits, letters for letters of the same case and script (or of ``alphabet``)."""
        out = []
        for c in text:
            if c.isdecimal() and not (alphabet and c in alphabet):
                out.append(str(self._below(stream, 10)))
            elif alphabet and c in alphabet:
                out.append(alphabet[self._below(stream, len(alphabet))])
            elif "a" <= c <= "z":
                out.append(chr(97 + self._below(stream, 26)))
            elif "A" <= c <= "Z":
                out.append(chr(65 + self._below(stream, 26)))
            elif "а" <= c <= "я" or "А" <= c <= "Я":
                out.append(chr(ord("а" if c.islower() else "А") + self._below(stream, 32)))
            else:
                out.append(c)
        return "".join(out)

    def canonical(self, kind: str, value: str, attempt: int = 0) -> str:
        """The surrogate of a canonical form, itself in canonical form and never the same; attempts give further ones."""
        for again in range(1000):
            out = self._draw(kind, value, f"{attempt}.{again}")
            if out != value:
                return out
        return out

    def _draw(self, kind: str, value: str, attempt: str) -> str:
        s = self._stream(kind, value, attempt)
        longer = max(0, int(attempt.split(".")[0]) - SAME_LENGTH_ATTEMPTS)
        if longer and not kind.startswith(("name_", *PARTS)):
            drawn = self._draw(kind, value, f"0.{attempt}")
            more = "".join(str(self._below(s, 10)) if kind in ("ip", "card", "phone", "ssn") else chr(97 + self._below(s, 26)) for _ in range(longer))
            return more + drawn if kind == "email" else drawn + more
        if kind == "email":
            local, _, domain = value.partition("@")
            labels = domain.split(".")
            own = self._stream("domain", domain, attempt.split(".")[0])  # mail of one domain stays together
            return self._like(local, s) + "@" + ".".join([self._like(x, own) for x in labels[:-1]] + labels[-1:])
        if kind == "ip":
            return ".".join(str(1 + self._below(s, 254)) for _ in range(4))
        if kind == "card":
            body = value[0] + self._like(value[1:-1], s)
            if not luhn(value):
                return body + str(self._below(s, 10))
            return next(body + d for d in "0123456789" if luhn(body + d))
        if kind == "iban":
            body = self._like(value[4:], s)
            check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
            return f"{value[:2]}{check:02d}{body}"
        if kind == "phone":
            m = re.match(r"\+\d", value)
            return (m[0] if m else "") + self._like(value[m.end() if m else 0 :], s)
        if kind == "ssn":
            return f"{1 + self._below(s, 665):03d}-{1 + self._below(s, 99):02d}-{1 + self._below(s, 9999):04d}"
        if kind == "access_key":
            return value[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[self._below(s, 32)] for _ in value[4:])
        if kind == "secret":
            hexes = "0123456789abcdef"
            return self._like(value, s, hexes if set(value) <= set(hexes) else "")
        if kind.startswith(PARTS):
            return self._part(kind, value, s, int(attempt.split(".")[0]))
        gender = kind[-1]
        script = "cyrillic" if "Ѐ" <= value[0] <= "ӿ" else "latin"
        last = SURNAMES[script]
        first = NAMES[gender, script] if gender != "n" else NAMES["m", script] + NAMES["f", script]
        surname = last[self._below(s, len(last))]
        if gender == "f" and script == "cyrillic":
            surname += "а"
        n = int(attempt.split(".")[0])  # the lists are short: every second attempt has a surname more
        surname += "".join("-" + last[self._below(s, len(last))] for _ in range((n + 1) // 2))
        return f"{first[self._below(s, len(first))]} {surname}" if " " in value else surname

    def _part(self, kind: str, value: str, s, n: int) -> str:
        """A given name or a surname; the lists are short, so every second attempt has a name more."""
        script = "cyrillic" if "Ѐ" <= value[0] <= "ӿ" else "latin"
        gender = kind[-1]
        names = SURNAMES[script] if kind == SURNAME else NAMES[gender, script] if gender != "n" else NAMES["m", script] + NAMES["f", script]
        out = names[self._below(s, len(names))]
        if kind == SURNAME and script == "cyrillic" and value[-1] in "ая":
            out += "а"
        return out + "".join("-" + names[self._below(s, len(names))] for _ in range((n + 1) // 2))

    def mention(self, kind: str, mention: str, surrogate: str, value: str = "") -> str:
        """A surrogate in the format of a mention: its punctuation and case, or the surname alone."""
        if kind == "email":
            return "".join(b.upper() if a.isupper() else b for a, b in zip(mention, surrogate, strict=True)) if len(mention) == len(surrogate) else surrogate
        if kind in ("card", "iban", "phone"):
            rest = iter(surrogate)
            return "".join(c if not (c.isalnum() or c == "+") else next(rest, "") for c in mention) + "".join(rest)
        if kind.startswith("name_") and " " in value and " " not in mention:
            return surrogate.split(" ")[-1]
        return surrogate


@lean("pii")
def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row's key, type, canonical form) of each text's entities, once each."""
    for batch in batches:
        keys, kinds, values = [], [], []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if text.is_valid:
                for kind, value in dict.fromkeys(part for _, _, kind, v in entities(text.as_py()) for part in name_parts(kind, v)):
                    keys.append(k)
                    kinds.append(kind)
                    values.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["k", "kind", "value"])


def _drawer(key: bytes):
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(key)
        for batch in batches:
            out = [s.canonical(k, v, a) for k, v, a in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["kind", "value", "attempt", "surrogate"])

    return draw


def exceptions(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) of the entities whose first surrogate is taken: by a smaller entity, or by one of the corpus.

    Of those that share a surrogate the smallest value keeps it; the others, and all whose surrogate is an entity, draw again,
    until none meets an entity, a surrogate drawn before, or another of its turn.  Only these are drawn anew, and each turn's domain is larger.
    """
    ddl = "kind string, value string, attempt int, surrogate string"
    drawn = stored(found.select("kind", "value").distinct().withColumn("attempt", F.lit(0)).mapInArrow(_drawer(key), ddl), "drawn")
    originals = drawn.select("kind", F.col("value").alias("surrogate"))

    def second(df: DataFrame) -> DataFrame:
        """Those that aren't the smallest of their surrogate."""
        keeper = df.groupBy("kind", "surrogate").agg(F.min("value").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        return df.join(keeper, ["kind", "surrogate"]).filter("value <> keeper").select("kind", "value")

    real = lambda df: df.join(originals, ["kind", "surrogate"], "left_semi").select("kind", "value")
    again = stored(second(drawn).unionByName(real(drawn)).distinct(), "again")
    taken = drawn.select("kind", "surrogate")
    settled, attempt = drawn.filter("attempt > 0"), 0
    while again.limit(1).count():
        attempt += 1
        turn = stored(again.withColumn("attempt", F.lit(attempt)).mapInArrow(_drawer(key), ddl), "turn")
        met = turn.join(taken, ["kind", "surrogate"], "left_semi").select("kind", "value")
        following = stored(second(turn).unionByName(real(turn)).unionByName(met).distinct(), "again")
        fresh = stored(turn.join(following, ["kind", "value"], "left_anti").select(*drawn.columns), "fresh")
        settled = settled.unionByName(fresh)
        taken = taken.unionByName(fresh.select("kind", "surrogate"))
        dropped(again, turn)
        again = following
    out = stored(settled.select("kind", "value", "surrogate"), "special")
    dropped(drawn, again)
    return out


def _replacer(key: bytes, text_at: int, special_at: int, keep: int):
    @lean("pii")
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(key)
        memo: dict[tuple[str, str], str] = {}
        for batch in batches:
            texts, counts = [], []
            for text, special in zip(batch.column(text_at), batch.column(special_at), strict=True):
                if not text.is_valid:
                    texts.append(None)
                    counts.append(0)
                    continue
                text = text.as_py()
                found = entities(text)
                counts.append(len(found))
                if found:
                    own = {(x["kind"], x["value"]): x["surrogate"] for x in special.as_py() or []}
                    out, at = [], 0
                    for a, b, kind, value in found:
                        parts = []
                        for part in name_parts(kind, value):
                            new = own.get(part) or memo.get(part)
                            if new is None:
                                if len(memo) > 50_000:
                                    memo.clear()
                                new = memo[part] = s.canonical(*part)
                            parts.append(new)
                        new = " ".join(parts)
                        out += [text[at:a], s.mention(kind, text[a:b], new, value)]
                        at = b
                    text = "".join([*out, text[at:]])
                texts.append(text)
            columns = [*batch.columns[:keep]]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], names=[*batch.schema.names[:keep], "n_entities"])

    return replace


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text's entities replaced, and n_entities (their number; a column of that name is replaced).

    A null text stays null with no entity, an empty one stays empty.  Texts of every length are searched whole.
    Null and repeated ids are carried along, for a row's exceptions go by its text; ``id_col`` isn't otherwise used.
    Equal rows give equal rows.  Other columns are kept, whatever their names.  An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    names_kept = [c for c in docs.columns if c != "n_entities"]
    free = "special"
    while any(c.lower().startswith(free) for c in names_kept):
        free += "_"
    docs = docs.select(*names_kept).withColumn(text_col, F.col(text_col).cast("string"))
    found = stored(docs.select(F.xxhash64(text_col).alias("k"), text_col).filter(F.col(text_col).isNotNull()).mapInArrow(_gather, "k long, kind string, value string"), "found")
    special = exceptions(found, key)
    by_text = stored(found.join(special, ["kind", "value"]).groupBy(F.col("k").alias(f"{free}k")).agg(F.collect_set(F.struct("kind", "value", "surrogate")).alias(free)), "by-text")
    dropped(found, special)
    joined = docs.join(by_text, F.xxhash64(text_col) == F.col(f"{free}k"), "left").select(*names_kept, free)
    schema = T.StructType([*docs.select(*names_kept).schema.fields, T.StructField("n_entities", T.IntegerType())])
    return joined.mapInArrow(_replacer(key, names_kept.index(text_col), len(names_kept), len(names_kept)), schema)
