"""PII surrogates: detected entities get keyed, type-consistent replacements.

A replacement keeps the kind, layout and script of what it stands for: digits for
digits, a card number passes the Luhn test if the original does, an IBAN has right
check digits, an address stays private or public, a given name keeps its gender.
It follows from the key and the entity's canonical form alone, so every mention of
an entity in any document gets the same one (coreference), however it is written.

Names are found by shape and context: capitalised words after a title, after words
that introduce a name ("my name is", "Dear", "contact", "signed"), before words that
only a person does ("wrote", "said"), before an e-mail address in brackets, or after
one of a few common given names. Each part of a name found so is then found wherever
it stands alone in the same text, capitalised, unless the text has the word in small
letters as well. A name that stands in none of these is not found.

Two entities must not meet in one replacement, and none may be a value that
really occurs. Both are checked on the table of distinct entities: of those that
meet, the smallest keeps its replacement and the others draw again, until none
meet. The values to draw from grow with the attempt (more syllables, letters or
digits, a wider range of addresses; numbers of SSN and national phones first begin
as no issued one does, and only in the end get more digits), so that any number of
entities settles. Only the entities that had to draw again are carried to their texts;
all other replacements are computed in place while the text is rewritten.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_columns

#: Given names by gender, and titles that tell it.
FEMALE = ("Alice", "Anna", "Beatriz", "Carla", "Clara", "Elena", "Emma", "Eva", "Frida", "Helena", "Ines", "Julia", "Karin", "Laura",
          "Lucia", "Maria", "Marie", "Marta", "Nora", "Olivia", "Paula", "Rosa", "Sara", "Sofia", "Susan", "Teresa", "Vera", "Mary", "Jane", "Linda")
MALE = ("Adam", "Albert", "Bruno", "Carlos", "Daniel", "David", "Erik", "Felix", "Hugo", "Jan", "John", "James", "Karl", "Lucas",
        "Marco", "Martin", "Miguel", "Oscar", "Pablo", "Paul", "Pedro", "Peter", "Robert", "Simon", "Thomas", "Victor", "Walter", "Michael", "Juan", "Hans")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Sra", "Señora", "Madame", "Lady")
MALE_TITLES = ("Mr", "Herr", "Señor", "Monsieur", "Sir")
OTHER_TITLES = ("Dr", "Prof")

_GENDER = {n: "f" for n in FEMALE} | {n: "m" for n in MALE}
_UP, _NAME = r"[^\W\d_a-zß-öø-ÿ]", r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_TITLES = "|".join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES)
#: Words that introduce a name, and words that follow one.
_BEFORE = ("my name is", "name is", "named", "I am", "I'm", "Dear", "contact", "signed by", "signed,", "written by", "sincerely,", "regards,", "Name:", "From:", "To:", "Attn:",
           "mein Name ist", "ich heiße", "je m'appelle", "je suis", "me llamo", "mi nombre es", "nombre:", "Nom:")
_AFTER = ("said", "says", "wrote", "writes", "asked", "replied", "answered", "lives at", "lives in", "works at", "works for", "called me", "schrieb", "sagte", "écrit", "escribió", "dijo")
#: Capitalised words that begin a sentence before a family name.
_STARTERS = frozenset(("Later", "Then", "Today", "Yesterday", "Tomorrow", "When", "After", "Before", "As", "But", "And", "Or", "While", "Once", "Now", "Here", "There", "So", "Also", "Finally", "Meanwhile", "However",
                       "If", "Though", "Since", "Because", "Dann", "Später", "Heute", "Gestern", "Und", "Aber", "Puis", "Ensuite", "Hier", "Mais", "Luego", "Después", "Ayer", "Pero"))
_CALL = r"(?:Tel|Telephone|Phone|Mobile|Cell|Fax|Call|Telefon|Tél|Teléfono)"
_KNOWN = "|".join(FEMALE + MALE)
_WORD = rf"{_UP}[^\W\d_]+(?:['’-][^\W\d_]+)*"  # a capitalised word of two letters or more
_FIND = re.compile("|".join((
    r"(?P<email>(?<![\w.%+-])[\w.%+-]{1,64}@(?:[\w-]{1,63}\.){1,10}[^\W\d_]{2,24})",
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
    r"(?P<ip>(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9]))",
    r"(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))",
    r"(?P<card>(?<![0-9A-Za-z+])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z]))",
    r"(?P<phone>\+[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\)\x20?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]))",
    rf"(?<!\w)(?i:{_CALL})\.?:?\x20(?P<called>0[0-9]{{1,4}}(?:[\x20/-][0-9]{{2,8}}){{1,4}})(?![0-9])",
    rf"(?P<person>(?<!\w)(?:(?:(?P<title>{_TITLES})\.?\x20(?={_UP}))(?:(?P<given>{_NAME})\x20(?={_UP}))?(?P<family>{_NAME})|(?P<known>{_KNOWN})\x20(?={_UP})(?P<last>{_NAME}))(?!\w))",
    rf"(?P<introduced>(?<!\w)(?i:{'|'.join(map(re.escape, _BEFORE))})\s{{1,3}}(?!(?i:{_TITLES})\.?\x20)(?P<given2>{_WORD})(?:\x20(?P<family2>{_WORD}))(?!\w))",
    rf"(?P<acting>(?<!\w)(?P<given3>{_WORD})\x20(?P<family3>{_WORD})(?=\x20(?:(?:{'|'.join(map(re.escape, _AFTER))})(?!\w)|[<(][\w.%+-]{{1,64}}@)))",
)))
_WORDS = re.compile(rf"(?<!\w){_NAME}(?!\w)")
#: A text without any of these has no entity, and is not searched.
_HINT = re.compile(rf"[0-9@]|(?<!\w)(?:{_TITLES}|{_KNOWN})(?!\w)|(?<!\w)(?i:{'|'.join(map(re.escape, _BEFORE))})\s|\x20(?:{'|'.join(map(re.escape, _AFTER))})(?!\w)")
#: First numbers of public IPv4 ranges without private or special parts.
_PUBLIC = [n for n in range(1, 224) if n not in (10, 100, 127, 169, 172, 192, 198, 203)]
_SYLLABLES = [a + b for a in "bdfgklmnprstv" for b in ("a", "e", "i", "o", "u")]


def _class(c: str) -> tuple[str, str]:
    """Script (first word of the character's name) and case of a letter or number."""
    case = {"Ll": "lower", "Lu": "upper"}.get(unicodedata.category(c), "letter" if c.isalpha() else "number")
    return unicodedata.name(c, "").split(" ")[0], case


@lru_cache(4096)
def _script(c: str) -> tuple[str, ...]:
    """What may stand for a letter or number outside the ranges that _alike states:
    those of its script and case in its 128 code points (all syllables of Hangul), or
    else of its case there, or else syllables. Small letters whose capital is no
    single letter or leads to another small one are not among them."""
    if "가" <= c <= "힣":
        return tuple(map(chr, range(0xac00, 0xd7a4)))
    script, case = _class(c)
    page = [x for x in map(chr, range(ord(c) & ~127, (ord(c) & ~127) + 128)) if x.isalnum() and not x.isascii() and _class(x)[1] == case
            and (case != "lower" or (len(x.upper()) == 1 and x.upper().lower() == x))]
    own = [x for x in page if _class(x)[0] == script]
    return tuple(own if len(own) > 1 else page if len(page) > 1 else _SYLLABLES)


class Entity:
    """kind, canonical value, and where it stands in the text."""

    __slots__ = ("kind", "value", "start", "end")

    def __init__(self, kind: str, value: str, start: int, end: int):
        self.kind, self.value, self.start, self.end = kind, value, start, end


def detect(text: str) -> list[Entity]:
    """Entities from left to right; a person gives one for each part of the name, and
    one for each bare mention of a part."""
    out: list[Entity] = []
    if not _HINT.search(text):
        return out
    names: dict[str, str] = {}  # parts of names as written, and their kinds
    for m in _FIND.finditer(text):
        kind = m.lastgroup
        if kind in ("email", "iban", "ip", "ssn", "card", "phone", "called"):
            span, kind = m.span(kind), "phone" if kind == "called" else kind
            written = text[slice(*span)]
            out.append(Entity(kind, written.lower() if kind == "email" else written if kind == "ip" else re.sub(r"[^0-9A-Za-z+]", "", written), *span))
            continue
        title = m["title"]
        given = next((g for g in ("given", "known", "given2", "given3") if m[g]), None)
        family = next(g for g in ("family", "last", "family2", "family3") if m[g])
        gender = "f" if title in FEMALE_TITLES else "m" if title in MALE_TITLES else "n"
        if given and not (given == "given3" and m[given] in _STARTERS):
            kind = "given_" + _GENDER.get(m[given], gender)
            out.append(Entity(kind, m[given].lower(), *m.span(given)))
            names.setdefault(m[given], kind)
        out.append(Entity("family", m[family].lower(), *m.span(family)))
        names.setdefault(m[family], "family")
    return _with_bare(text, out, names) if names else out


def _with_bare(text: str, found: list[Entity], names: dict[str, str]) -> list[Entity]:
    """Entities and the bare mentions of names, outside of them: capitalised as
    written, or in capitals, also before an apostrophe; of words that the text has in
    small letters, none. One pass over the words, whatever the number of names."""
    small, k = set(), 0
    for m in _WORDS.finditer(text):
        while k < len(found) and found[k].end <= m.start():
            k += 1
        if m[0][0].islower() and (k == len(found) or found[k].start >= m.end()):
            small.add(m[0])
    one = {n: k for n, k in names.items() if len(n) > 1 and n[0].isupper() and n.lower() not in small}
    kinds = {n.upper(): k for n, k in one.items()} | one
    out, k = [], 0
    for m in _WORDS.finditer(text) if kinds else ():
        word = m[0] if m[0] in kinds else re.split("['’]", m[0])[0]
        if word not in kinds:
            continue
        while k < len(found) and found[k].end <= m.start():
            out.append(found[k])
            k += 1
        end = m.start() + len(word)
        if k == len(found) or found[k].start >= end:
            out.append(Entity(kinds[word], word.lower(), m.start(), end))
    return out + found[k:]


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[::-1]]
    return sum(odd[::2] + [sum(divmod(2 * x, 10)) for x in odd[1::2]]) % 10 == 0


def _grown(attempt: int) -> int:
    """By how many signs the replacements of an attempt are longer: none up to the
    fifth, then one more every other attempt."""
    return max(0, attempt - 4) // 2


class Surrogates:
    """Keyed replacements; attempt is raised when one has met another."""

    def __init__(self, key: bytes):
        self.key = key

    def _numbers(self, *what: object) -> Iterator[int]:
        """An endless stream of numbers that follows from the key and its arguments."""
        block, seed = 0, "\x1f".join(map(str, what)).encode()
        while True:
            yield from hmac.digest(self.key, seed + b"\x1f%d" % block, "sha256")
            block += 1

    def _pick(self, r: Iterator[int], n: int) -> int:
        return int.from_bytes(bytes(next(r) for _ in range(4)), "big") % n

    def _alike(self, text: str, r: Iterator[int]) -> str:
        """Each digit and letter replaced by one of its kind, case and script."""
        out = []
        for c in text:
            if c.isascii() and c.isdigit():
                out.append(str(self._pick(r, 10)))
            elif c.isascii() and c.isalpha():
                out.append(chr(ord("a" if c.islower() else "A") + self._pick(r, 26)))
            elif "а" <= c <= "я":
                out.append(chr(0x430 + self._pick(r, 32)))
            elif "А" <= c <= "Я":
                out.append(chr(0x410 + self._pick(r, 32)))
            elif "α" <= c <= "ω" and c != "ς":
                out.append("αβγδεζηθικλμνξοπρστυφχψω"[self._pick(r, 24)])
            elif "à" <= c <= "ü" and c != "÷":
                out.append("àáâãäåçèéêëìíîïñòóôõöùúûü"[self._pick(r, 25)])
            elif "一" <= c <= "龥":
                out.append(chr(0x4e00 + self._pick(r, 20_000)))
            elif c.isalnum():
                like = _script(c)
                out.append(like[self._pick(r, len(like))])
            else:
                out.append(c)
        return "".join(out)

    def _more(self, text: str, r: Iterator[int], attempt: int) -> str:
        """From the sixth attempt on, ever more letters like the last one of the text."""
        last = next((c for c in reversed(text) if c.isalpha()), "a")
        return "".join(self._alike(last, r) for _ in range(_grown(attempt)))

    def canonical(self, kind: str, value: str, attempt: int = 0) -> str:
        """The canonical form of the replacement."""
        r = self._numbers(kind, value, attempt)
        if kind == "email":
            local, _, domain = value.rpartition("@")
            host, _, top = domain.rpartition(".")
            return f"{self._alike(local, r)}{self._more(local, r, attempt)}@{self._alike(host, self._numbers('domain', domain, 0))}.{top}"
        if kind == "ip":
            a = value.split(".")
            keep = 2 if value.startswith(("192.168.", "127.0.")) else 1 if a[0] in ("10", "127") else 0
            new = [str(self._pick(r, 256)) for _ in a]
            if not keep:
                new[0] = str((11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 23, 24)[self._pick(r, 12)] if int(a[0]) < 128 else 130 + self._pick(r, 38))
                if attempt > 5:  # any range of public addresses
                    new[0] = str(_PUBLIC[self._pick(r, len(_PUBLIC))])
            elif attempt > 5 and a[0] == "192":
                a, keep = ["10"], 1
            elif attempt > 5:
                keep = 1
            if keep and attempt > 11:  # reserved, so not public either
                return ".".join([str(240 + self._pick(r, 15)), *new[1:]])
            return ".".join(a[:keep] + new[keep:])
        if kind == "card":
            same = luhn(value)
            while True:
                new = value[0] + self._alike(value[1:], r)
                if luhn(new) == same:
                    return new
        if kind == "iban":
            body = self._alike(value[4:] if attempt < 6 else "".join("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[self._pick(r, 36)] for _ in value[4:]), r)
            number = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
            return f"{value[:2]}{98 - number % 97:02d}{body}"
        if kind == "phone":
            lead = 2 if value.startswith("+") else 0
            if lead or attempt < 12:
                return value[:lead] + self._alike(value[lead:] + "0" * (_grown(attempt) if lead else 0), r)
            return "01"[self._pick(r, 2)] + self._alike(value[1:] + "0" * _grown(attempt - 60), r)
        if kind == "ssn" and attempt > 11:
            return "9" + self._alike(value[1:] + "0" * _grown(attempt - 60), r)
        if kind.startswith("given_"):
            pool = {"f": FEMALE, "m": MALE}.get(kind[-1], FEMALE + MALE)
            if value.isascii() and attempt < 6:
                return pool[self._pick(r, len(pool))].lower()
            end = {"f": "a", "m": "o"}.get(kind[-1], "e")
            if value.isascii():
                return "".join(_SYLLABLES[self._pick(r, 65)] for _ in range(1 + _grown(attempt)))[:-1] + "n" + end
            return self._alike(value, r) + self._more(value, r, attempt)
        if kind == "family":
            if value.isascii():
                return "".join(_SYLLABLES[self._pick(r, 65)] for _ in range(4 + _grown(attempt)))
            return self._alike(value, r) + self._more(value, r, attempt)
        return self._alike(value, r)

    def render(self, entity: Entity, written: str, attempt: int = 0) -> str:
        """The replacement in the layout of the mention."""
        new = self.canonical(entity.kind, entity.value, attempt)
        if entity.kind == "email":
            return new.upper() if written.isupper() else new
        if entity.kind == "family" or entity.kind.startswith("given_"):
            return new.upper() if written.isupper() and len(written) > 1 else new[:1].upper() + new[1:]
        if entity.kind == "ip":
            return new
        signs = iter(new)
        return "".join(next(signs) if re.match(r"[0-9A-Za-z+]", c) else c for c in written) + "".join(signs)


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, e.kind, e.value) for i, text in zip(batch.column("row").to_pylist(), batch.column("text")) for e in detect(text.as_py() or "")]
        i, k, v = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.string()), pa.array(v, pa.string())], ["row", "kind", "value"])


def mentions(docs: DataFrame) -> DataFrame:
    """(row, text) -> row, kind, value of every entity in every whole text."""
    return docs.select("row", "text").mapInArrow(_entities, "row long, kind string, value string")


def resolve(entities: DataFrame, key: bytes) -> DataFrame:
    """Distinct (kind, value) -> (kind, value, attempt) of those that had to draw
    again, so that all replacements of a kind differ, and differ from all values
    that occur. A round moves only what still meets: what is taken is looked up by the
    replacements still open. It settles, as ever more values are there to draw from."""
    made = Surrogates(key)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [made.canonical(*x) for x in zip(*(b.column(c).to_pylist() for c in ("kind", "value", "attempt")))]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("value"), b.column("attempt"), pa.array(new, pa.string())], ["kind", "value", "attempt", "new"])

    schema = "kind string, value string, attempt int, new string"
    real = materialize(entities.select("kind", "value").distinct(), "entities")
    # given names of one gender come from a short list, and many people share one
    open_ = real.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema)
    settled = None
    taken = real.select("kind", F.col("value").alias("new"))
    while True:
        open_ = materialize(open_, "drawn")
        asked = open_.select("kind", "new").distinct()
        bad = taken.join(asked, ["kind", "new"], "left_semi")
        if settled is not None:
            bad = bad.unionByName(settled.select("kind", "new").join(asked, ["kind", "new"], "left_semi"))
        first = open_.groupBy("kind", "new").agg(F.min("value").alias("first"))
        at = (open_.join(first, ["kind", "new"]).join(bad.distinct().withColumn("bad", F.lit(True)), ["kind", "new"], "left")
              .withColumn("again", F.col("bad").isNotNull() | (F.col("value") != F.col("first"))))
        at = materialize(at.select("kind", "value", "attempt", "new", "again"), "round")
        good = at.filter("not again").drop("again")
        settled = good if settled is None else settled.unionByName(good)
        left = at.filter("again")
        if left.isEmpty():
            return settled.filter("attempt > 0").select("kind", "value", "attempt")
        open_ = left.withColumn("attempt", F.col("attempt") + 1).select("kind", "value", "attempt").mapInArrow(draw, schema)


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: doc_id, n_entities, kinds (kind:number, by kind), text
    with all entities replaced.

    A null text stays null with no entities. Rows are independent except for the
    shared replacements, so repeated and null ids pass through; an entity's
    replacement is the same in all rows. Extra columns are ignored; an empty table
    gives no rows. Long texts are rewritten whole.
    """
    secret = key.encode()
    d = with_columns(docs, {"doc_id": "long", "text": "string"})
    # rows meet their redrawn entities by a hash of the text: ids may be null or
    # repeated, copies share one entry, and texts of one hash only share a larger map
    d = d.withColumn("row", F.xxhash64("text"))
    found = materialize(mentions(d), "mentions")
    again = materialize(resolve(found, secret), "redrawn")
    by_text = (found.join(again, ["kind", "value"]).distinct().groupBy("row")
               .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "value"), "attempt"))).alias("again")))
    by_text = materialize(by_text, "redrawn-by-text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(secret)
        for batch in batches:
            n, kinds, out = [], [], []
            for text, redrawn in zip(batch.column("text"), batch.column("again")):
                s, attempts = text.as_py(), dict(redrawn.as_py() or ())
                es = detect(s) if s else []
                parts, at, count = [], 0, {}
                for e in es:
                    parts += [s[at:e.start], made.render(e, s[e.start:e.end], attempts.get(f"{e.kind}:{e.value}", 0))]
                    at = e.end
                    count[e.kind] = count.get(e.kind, 0) + 1
                n.append(len(es))
                kinds.append(",".join(f"{k}:{count[k]}" for k in sorted(count)))
                out.append("".join([*parts, s[at:]]) if es else s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(kinds, pa.string()), pa.array(out, pa.string())],
                                             ["doc_id", "n_entities", "kinds", "text"])

    joined = d.join(by_text, "row", "left").select("doc_id", "text", "again")
    return joined.mapInArrow(rewrite, "doc_id long, n_entities long, kinds string, text string")
