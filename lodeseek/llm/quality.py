"""Line-first cleaning: rules on each line first, then a verdict on the document by how much text they leave.

A line that holds a word fails if any rule below finds it:

* punctuation: it doesn't end in a mark of LINE_END, closing quotes and brackets aside;
* symbols: a tenth or more of its characters are of ``[#*$%&|<>]``;
* navigation: three or more ``|``, or two or more ``>`` or ``»`` between its words; or, marks at its end aside, a line of at
  most SHORT words is made of a menu's words alone, or of three or more parts of one to three words with ``| • · › »``
  between them;
* boilerplate: a line of at most SHORT words holds one of its phrases, begins with one of its openings, or is one of its
  whole lines.

Menus, phrases, openings and whole lines are lists by language (RULES); all chosen languages' lists hold for every line,
as pages mix languages, and ``rules`` takes others. Failing lines are removed. A document is kept if the base rules hold and the lines left have at least ``keep_percent``
of its words. One Arrow pass over whole texts, no shuffle; all statistics come from UTF-8 bytes.

Defined results: a null or empty text has no words and fails the base rules; lines of white space alone are neither
judged nor counted; repeated rows are judged each alone; columns of other names are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import bytes_of, map_batches

SYMBOLS = "#*$%&|<>"
LINE_END = r"[.!?:;…。！？]['\"”’»)\]]*$"
#: Words of a line that navigation's lists and boilerplate may find.
SHORT = 12
#: By language: menu entries, phrases, openings and whole lines, as patterns without groups of their own.
RULES: dict[str, dict[str, tuple[str, ...]]] = {
    "en": {
        "menu": ("home", "about(?: us)?", "contact(?: us)?", "menu", "log ?in", "sign in", "register", "search", "help", "faq", "site ?map", "next", "previous", "prev", "back", "top", "news", "blog", "shop", "cart"),
        "phrases": ("cookie policy", "(?:uses?|accept|using) (?:all )?cookies", "privacy policy", "terms of (?:use|service)", "all rights reserved", "enable javascript", "lorem ipsum", "skip to (?:main )?content"),
        "openings": ("click here", "sign up for", "subscribe to our", "share this", "powered by"),
        "whole": ("read more", "continue reading", "learn more", "show more", "subscribe"),
    },
    "fr": {
        "menu": ("accueil", "à propos", "contact(?:ez-nous)?", "menu", "connexion", "inscription", "recherche", "aide", "plan du site", "suivant", "précédent", "retour", "haut de page", "actualités", "boutique", "panier"),
        "phrases": ("politique de confidentialité", "(?:utilise|accepter) (?:des|les|tous les) cookies", "conditions (?:générales )?d['’]utilisation", "mentions légales", "tous droits réservés", "activer javascript"),
        "openings": ("cliquez ici", "inscrivez-vous à", "abonnez-vous à", "partagez? cet", "propulsé par"),
        "whole": ("lire la suite", "en savoir plus", "voir plus", "s['’]abonner"),
    },
    "de": {
        "menu": ("startseite", "über uns", "kontakt", "menü", "anmelden", "registrieren", "suche", "hilfe", "inhaltsverzeichnis", "weiter", "zurück", "nach oben", "aktuelles", "neuigkeiten", "warenkorb"),
        "phrases": ("datenschutzerklärung", "(?:verwendet|akzeptieren|alle) cookies", "nutzungsbedingungen", "alle rechte vorbehalten", "javascript (?:zu )?aktivieren", "zum inhalt springen"),
        "openings": ("hier klicken", "klicken sie hier", "abonnieren sie", "bereitgestellt von"),
        "whole": ("weiterlesen", "mehr lesen", "mehr erfahren", "mehr anzeigen", "impressum"),
    },
    "es": {
        "menu": ("inicio", "acerca de", "quiénes somos", "contacto", "menú", "iniciar sesión", "registrarse", "buscar", "ayuda", "mapa del sitio", "siguiente", "anterior", "volver", "arriba", "noticias", "tienda", "carrito"),
        "phrases": ("política de (?:privacidad|cookies)", "(?:utiliza|aceptar) (?:las |todas las )?cookies", "términos (?:y condiciones|de uso|de servicio)", "aviso legal", "todos los derechos reservados", "(?:habilite|active) javascript"),
        "openings": ("haga clic aquí", "haz clic aquí", "suscríbe[ts]e a", "comparte est[ea]", "desarrollado por"),
        "whole": ("leer más", "seguir leyendo", "ver más", "saber más"),
    },
}
#: What is taken off a line's end before its words are compared with lists.
MARKS = ".!?:;…。！？'\"”’»)]"
_PART = r"[^ \t|•·›»]+(?:[ \t]+[^ \t|•·›»]+){0,2}"
PARTS = rf"{_PART}(?:[ \t]*[|•·›»][ \t]*{_PART}){{2,}}"


def patterns(rules: dict[str, dict[str, tuple[str, ...]]] = RULES) -> tuple[str, str]:
    """Patterns that a short line without its end marks matches whole: of menus, and of boilerplate."""

    def any_of(kind: str) -> str:
        return "|".join(dict.fromkeys(x for r in rules.values() for x in r.get(kind, ()))) or r"[^\x00-\x{10FFFF}]"

    menu = any_of("menu")
    return rf"(?i)(?:{menu})(?:[ \t|,·•/>»›-]+(?:{menu}))*", f"(?i)(?:.*(?:{any_of('phrases')}).*|(?:{any_of('openings')}).*|{any_of('whole')})"


ARROW = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), *((n, pa.int64()) for n in ("n_lines", "n_failed_lines", "kept_words")), ("clean_text", pa.binary())])
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_failed_lines long, kept_words long, clean_text binary"

_ends = re.compile(LINE_END.encode().replace("[.!?:;…。！？]".encode(), b"(?:[.!?:;]|" + "|".join("…。！？").encode() + b")").replace("['\"”’»)\\]]*".encode(), b"(?:['\")\\]]|" + "|".join("”’»").encode() + b")*")).search
_parts = re.compile(PARTS).fullmatch


def repeat_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of three that the text has twice or more."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    key = ids[: -window + 1]
    for k in range(1, window):
        if len(number) ** 2 >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(number) + ids[k : len(ids) - window + 1 + k]
        key = key if k == window - 1 else np.unique(key, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    inside = np.zeros(len(ids), bool)
    for k in range(window):
        inside[k : len(key) + k] |= twice
    return int(inside.sum())


def found_by(rules: dict[str, dict[str, tuple[str, ...]]] = RULES) -> Callable[[str], bool]:
    """Whether a short line without its end marks is of a menu or boilerplate."""
    menu, boilerplate = (re.compile(p.replace(r"[^\x00-\x{10FFFF}]", r"(?!)")).fullmatch for p in patterns(rules))
    return lambda line: bool(menu(line) or _parts(line) or boilerplate(line))


_found = found_by()


def line_fails(line: bytes, found: Callable[[str], bool] = _found) -> bool:
    """line: without white space at its ends, and with a word."""
    if not _ends(line):
        return True
    symbols = len(line) - len(line.translate(None, SYMBOLS.encode()))
    if symbols and 10 * symbols >= len(line.decode("utf-8", "replace")):
        return True
    if line.count(b"|") >= 3 or line.count(b" > ") + line.count(" » ".encode()) >= 2:
        return True
    return len(line.split(None, SHORT)) <= SHORT and found(line.decode("utf-8", "replace").rstrip(MARKS))


def judge(keep_percent: int, texts: bool, rules: dict[str, dict[str, tuple[str, ...]]] = RULES) -> Callable[[dict], dict]:
    symbols = SYMBOLS.encode()
    found = None

    def run(rows: dict[str, list]) -> dict[str, list]:
        nonlocal found
        found = found or found_by(rules)
        out: dict[str, list] = {f.name: [] for f in ARROW}
        add = [out[f.name].append for f in ARROW]
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            text = text or b""
            words = text.split()
            n = len(words)
            joined = b"".join(words)
            chars = len(joined) if joined.isascii() else int(((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80).sum())
            seen: set[bytes] = set()
            dup = lines = failed = left = 0
            clean = []
            for line in text.split(b"\n"):
                if bare := line.strip():
                    lines += 1
                    if line in seen:
                        dup += 1
                    else:
                        seen.add(line)
                    if line_fails(bare, found):
                        failed += 1
                    else:
                        left += len(bare.split())
                        if texts:
                            clean.append(line)
            repeats = repeat_words(words)
            base = n < 50 or 100 * repeats > 50 * n
            kept = not base and 100 * left >= keep_percent * n
            for f, x in zip(add, (doc_id, n, chars, len(text) - len(text.translate(None, symbols)), dup, repeats, base, kept, lines, failed, left, b"\n".join(clean) if texts and kept else None)):
                f(x)
        return out

    return run


def clean_lines(docs: DataFrame, keep_percent: int = 50, texts: bool = True, rules: dict[str, dict[str, tuple[str, ...]]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA's columns for each row of docs, clean_text as a string: the lines left of a kept document, else null."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), bytes_of(text_col).alias("text"))
    out = map_batches(src, judge(keep_percent, texts, rules), SCHEMA, ARROW)
    return out.withColumn("clean_text", F.col("clean_text").cast("string"))
