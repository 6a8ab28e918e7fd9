"""The main article of a web page, by text-to-tag ratios over the events of a streaming parser.

The standard-library parser hands over tags and text one by one; text between block-level tags
is a line. Each line has a text-to-tag ratio; the ratios are smoothed with a Gaussian kernel, and
two thresholds on them make clusters: lines above the upper one are cores, lines above the lower
one belong to a cluster with a core. The smallest container of the headline that holds half of the
cores' text is the article's, less boxes that aren't mostly cores and parts that open something
else (titles or remarks of low ratio under a heading, or a usual heading of such parts). If the
container is the whole page, clusters under half of the largest are left out. Then lines that
are furniture by what they say (bylines, sharing, notices, advertising) are taken out.

The same region rule serves text that has been flattened: there a sentence is a line.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.residue import is_notice, menu_of
from tarnweave.llm.samples import spread

INLINE = frozenset({"a", "b", "i", "em", "strong", "span", "code"})
_SILENT = frozenset({"script", "style", "noscript", "template"})
_VOID = frozenset({"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "param", "track"})
_BOXES = frozenset({"div", "aside", "nav", "footer", "header", "section", "table", "form", "article", "main", "td", "dialog", "menu", "tr", "tbody"})
#: Boxes that are no part of the text they stand in.
_ASIDE = frozenset({"aside", "nav", "footer", "form", "dialog", "menu"})
_CLOSES_P = frozenset({"p", "div", "section", "article", "aside", "nav", "footer", "header", "ul", "ol", "table", "blockquote", "figure", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "main", "form", "pre", "dl", "hr"})
_SAME = {"li": "li", "td": "td", "th": "td", "tr": "tr", "dt": "dt", "dd": "dd", "option": "option"}

SIGMA, KERNEL = 1.0, 2
#: Shares of the page's mean smoothed ratio, from which a line is a core of a cluster, and from which it may be in one.
CORE, NEAR = 0.5, 0.2
_HEADINGS = frozenset({"h2", "h3", "h4", "h5", "h6"})
_WEIGHTS = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-KERNEL, KERNEL + 1)]

#: Lines that open something that isn't the article (fixed values, usual headings).
OPENERS = frozenset(
    s.strip()
    for s in (
        "related articles|most read|comments|more from this section|you may also like|related|read also|read next|recommended|popular|see also|leave a comment|newsletter|about the author"
        "|meist gelesen|mehr zum thema|kommentare|verwandte artikel|das könnte sie auch interessieren|über den autor"
        "|les plus lus|à lire aussi|commentaires|articles liés|sur le même thème|lo más leído|lea también|comentarios|artículos relacionados|i più letti|leggi anche|commenti|articoli correlati"
        "|mais lidas|leia também|comentários|artigos relacionados|самое читаемое|читайте также|комментарии|похожие статьи"
    ).split("|")
)
#: Entries of a list of ways to share (fixed values).
SHARING = frozenset(
    (
        "copy link|save for later|send by mail|share this page|print|share|tweet|drucken|link kopieren|per mail senden|seite teilen|teilen|merken|imprimer|copier le lien|envoyer par mail|partager|imprimir|copiar enlace|enviar por correo|compartir"
        "|stampa|copia il link|condividi|invia per mail|compartilhar|copiar link|enviar por e-mail|enviar por email|поделиться|печать|копировать ссылку|отправить по почте|guardar|salvar|sauvegarder|salva"
    ).split("|")
)
_BYLINE = re.compile(r"^(?:by|von|par|por|di|da|автор)\s+\S.{2,60}\d{4}$", re.I)
_MENU = re.compile(r"^[^|·›»>]{1,40}(?:\s+[|·]\s+[^|·]{1,40}){2,}$|\S\s+›\s+\S")
_NOTICE = re.compile(
    r"^©|rights reserved|rechte vorbehalten|droits réservés|derechos reservados|direitos reservados|diritti riservati|права защищены|^(?:[^:]{1,40}: )?(?:terms of use|privacy\.|imprint\.|impressum\.|aviso legal|note legali|mentions légales|правила сайта|prices include tax|alle preise mit|precios con imp|prix taxes|prezzi con|preços com|reproduction only with|powered by a)"
    r"|^we use cookies|use of cookies|cookie policy|cookies um ihren|^wir verwenden cookies|^nous utilisons des cookies|^usamos cookies|^usiamo i cookie|используем файлы cookie|^your privacy matters|^this site stores|speichert daten auf|garde des données sur|guarda datos en su|salva dati su|guarda dados|сайт (?:хранит|сохраняет)|^questo sito (?:salva|conserva)|^este site (?:guarda|armazena)"
    r"|newsletter and never|^subscribe to|weekly digest in your inbox|^enter your email|rundbrief|das neueste per mail|abonnez-vous|le meilleur dans votre boîte|^suscríbase|lo mejor en su correo|^iscriviti|il meglio (?:nella|della)|^assine o|o melhor (?:no|da)|подпишитесь на|нашу рассылку|лучшее (?:за неделю|на почту)",
    re.I,
)
_ADVERT = re.compile(
    r"^(?:advertisement|sponsored|anzeige|publicité|publicidad|publicidade|pubblicità|реклама)\b|^partner offer|^(?:angebot|offre|oferta|offerta) (?:unseres|de notre|de nuestro|do nosso|del nostro)|\b\d+ (?:percent on|prozent sparen|pour cent|por ciento|por cento|per cento)\b.{0,30}$|\b\d+ процент\w*.{0,30}$",
    re.I,
)
_REMARK = re.compile(r"^[^\W\d_][\w'’-]{1,30}(?: [^\W\d_][\w'’-]{1,30})?: \S")
_WHOLE = re.compile(r"[.!?…][”\"»’)\]]*$")
_NOTE_CLASS = re.compile(r"\b(?:bio|author|byline|by|notice|cookie|share|social|advert|ad|ads|promo|related|comments?|footer|nav|menu|breadcrumb|newsletter|dialog)\b", re.I)


class Line:
    """A run of text between block-level tags, and where it stands."""

    __slots__ = ("hint", "links", "path", "tags", "text")

    def __init__(self, text: str, tags: int, links: int, path: tuple, hint: str):
        self.text, self.tags, self.links, self.path, self.hint = text, tags, links, path, hint

    @property
    def tag(self) -> str:
        return self.path[-1][0] if self.path else ""


class _Events(HTMLParser):
    def __init__(self, whole: bool):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple] = []
        self.parts: list[str] = []
        self.tags = self.links = self.number = self.silent = 0
        self.in_link = False
        self.body = whole

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                self.lines.append(Line(text, self.tags, self.links, tuple(self.stack), self.stack[-1][2] if self.stack else ""))
        self.tags = self.links = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body":
            self.body = True
            return
        if tag in INLINE:
            self.tags += 1
            if tag == "a":
                self.in_link = True
            return
        self.flush()
        self.tags += 1
        if tag in _SILENT:
            self.silent += 1
            return
        if tag in _VOID:
            return
        if tag in _CLOSES_P and self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
        same = _SAME.get(tag)
        if same:
            for i in range(len(self.stack) - 1, -1, -1):
                name = self.stack[i][0]
                if name == same:
                    del self.stack[i:]
                    break
                if name in ("ul", "ol", "table", "dl", "select"):
                    break
        self.number += 1
        hint = ""
        for k, v in attrs:
            if v and k in ("class", "id", "role"):
                hint = f"{hint} {v}"
        self.stack.append((tag, self.number, hint))

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.tags += 1
            if tag == "a":
                self.in_link = False
            return
        self.flush()
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.body and not self.silent:
            self.parts.append(data)
            if self.in_link:
                self.links += len(data)


def lines_of(html: str) -> list[Line]:
    """The lines of a page's body; a page without a body tag is all body, but for its head."""
    parser = _Events("<body" not in html.lower())
    parser.feed(html if not parser.body else re.sub(r"(?is)<head\b.*?</head>|<title\b.*?</title>", "", html))
    parser.close()
    parser.flush()
    return parser.lines


def smoothed_ratios(lines: list[Line]) -> list[float]:
    """Text-to-tag ratio of each line, smoothed over its neighbours."""
    raw = [len(x.text) / max(1, x.tags) for x in lines]
    out = []
    for i in range(len(raw)):
        total = weight = 0.0
        for k, w in zip(range(-KERNEL, KERNEL + 1), _WEIGHTS, strict=True):
            if 0 <= i + k < len(raw):
                total += w * raw[i + k]
                weight += w
        out.append(total / weight)
    return out


def _furniture(line: Line) -> bool:
    """What a line says or is marked as, if that makes it furniture."""
    text = line.text
    low = text.lower()
    if low in SHARING or _MENU.search(text) or _BYLINE.match(text) or _ADVERT.search(text):
        return True
    if len(text) < 140 and _NOTICE.search(text):
        return True
    if line.links >= 0.9 * len(text) and len(text) < 40:
        return True
    return bool(line.hint and _NOTE_CLASS.search(line.hint))


def main_lines(html: str) -> list[Line]:
    """The lines of the main article, in their order.

    Lines whose smoothed ratio is at least CORE of the page's mean are cores; a cluster is a run
    of lines of at least NEAR of it with a core among them. No line outside a cluster is taken,
    so a page without cores has no article.
    """
    lines = lines_of(html)
    if not lines:
        return []
    ratios = smoothed_ratios(lines)
    mean = sum(ratios) / len(ratios)
    furniture = [_furniture(x) for x in lines]
    openers = [x.text.lower().rstrip(":") in OPENERS or _opens_titles(lines, i, mean) for i, x in enumerate(lines)]
    content = [r > 0 and r >= CORE * mean and not f and not o and x.links < 0.5 * len(x.text) for x, r, f, o in zip(lines, ratios, furniture, openers, strict=True)]
    near = [r > 0 and r >= NEAR * mean for r in ratios]
    if not any(content):
        return []
    head = next((i for i, x in enumerate(lines) if x.tag == "h1"), None)
    if head is None:
        # No headline: the cluster with the most text in its cores leads itself.
        best, start = (0, 0, 0), None
        for i in range(len(lines) + 1):
            if i < len(lines) and near[i] and not openers[i]:
                start = i if start is None else start
            elif start is not None:
                best, start = max(best, (sum(len(lines[k].text) for k in range(start, i) if content[k]), start, i)), None
        return [lines[i] for i in range(best[1], best[2]) if not furniture[i]]
    depth = _container(lines, head, content, openers)
    return [lines[i] for i in _region(lines, head, depth, content, near, furniture, openers)]


def _opens_titles(lines: list[Line], at: int, mean: float) -> bool:
    """A heading whose part of its box holds titles, links or short remarks only, and little text to its tags.

    Such a part is a list of other articles or of comments, whatever its heading says.
    """
    if lines[at].tag not in _HEADINGS:
        return False
    path = lines[at].path
    box = path[: max(_boxes(path[:-1], 0), default=0)]
    ratios = []
    for x in lines[at + 1 :]:
        if x.tag in _HEADINGS or not _within(x, box) or x.tag not in ("li", "p", "a", "dd", "dt"):
            break
        if _WHOLE.search(x.text) and not _REMARK.match(x.text):
            return False
        ratios.append(len(x.text) / max(1, x.tags))
    return len(ratios) > 1 and sum(ratios) < mean * len(ratios)


def _within(x: Line, path: tuple) -> bool:
    return len(x.path) >= len(path) and all(a[1] == b[1] for a, b in zip(x.path, path, strict=False))


def _boxes(path: tuple, depth: int) -> list[int]:
    """Where the boxes of a path end that are deeper than a container."""
    return [k + 1 for k in range(depth, len(path)) if path[k][0] in _BOXES]


def _container(lines: list[Line], head: int, content: list[bool], openers: list[bool]) -> int:
    """The depth of the smallest container of the headline that holds half of the page's content."""
    opened: list[tuple] = []
    weights = []
    for x, c, o in zip(lines, content, openers, strict=True):
        if o:
            opened.append(x.path[: max(_boxes(x.path[:-1], 0), default=0)])
        weights.append(len(x.text) if c and not any(_within(x, p) for p in opened) else 0)
    weights[head] = 0
    home = lines[head].path[:-1]
    for depth in range(len(home), 0, -1):
        if 2 * sum(w for x, w in zip(lines, weights, strict=True) if w and _within(x, home[:depth])) >= sum(weights):
            return depth
    return 0


def _region(lines: list[Line], head: int, depth: int, content: list[bool], near: list[bool], furniture: list[bool], openers: list[bool]) -> list[int]:
    """The lines of the article in the headline's container: clusters of content, cut where something else is opened.

    What openers open, and boxes whose text isn't mostly content, is left out, and so is every
    cluster without a core. On a page without a box of the article's own the headline's cluster is
    taken, and later ones at least half as large as the largest.
    """
    home = lines[head].path[:depth]
    inside = [i for i in range(head + 1, len(lines)) if _within(lines[i], home)]
    # Text and content of each box, by its own lines.
    boxes: dict[tuple, list[int]] = {}
    for i in inside:
        x = lines[i]
        own = x.path[: max(_boxes(x.path, depth), default=depth)]
        share = boxes.setdefault(own, [0, 0])
        share[0] += len(x.text)
        share[1] += len(x.text) * content[i]
    clusters: list[list[int]] = [[head]]
    opened: list[tuple] = []
    before: set[tuple] = set()
    parted, loose = False, not any(step[0] in _BOXES for step in home)
    at = lines[head].path[: max(_boxes(lines[head].path, depth), default=depth)]
    for i in inside:
        x = lines[i]
        deeper = _boxes(x.path, depth)
        own = x.path[: deeper[-1] if deeper else depth]
        if openers[i]:
            # The largest box that holds no content before its opener is opened as a whole; the opener may be a box itself.
            around = [k for k in deeper if k < len(x.path)]
            opened.append(next((x.path[:k] for k in around if x.path[:k] not in before), x.path[: max(around, default=depth)]))
            parted = loose
            continue
        shut = any(_within(x, p) for p in opened) or any(x.path[k - 1][0] in _ASIDE or _NOTE_CLASS.search(x.path[k - 1][2]) for k in deeper)
        if shut or deeper and own != at and boxes[own][1] < 0.75 * boxes[own][0]:
            parted = loose
            continue
        if not near[i]:
            parted = True
            continue
        if furniture[i]:
            continue
        if parted:
            clusters.append([])
            parted = False
        clusters[-1].append(i)
        before.update(x.path[:k] for k in deeper)
    sizes = [sum(len(lines[i].text) for i in c if content[i] and i != head) for c in clusters]
    out: list[int] = []
    for k, c in enumerate(clusters):
        if k and (not sizes[k] or loose and 2 * sizes[k] < max(sizes)):
            continue
        out += c
    return out


def block_md5(text: str) -> str:
    return hashlib.md5(text.encode("utf-8"), usedforsecurity=False).hexdigest()


def main_blocks(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, block, tag, text, block_md5) of each block of each page's main article.

    Null or blank html gives no rows; null ids are kept; repeated rows of a page repeat their
    blocks; broken markup is read as far as it goes; other columns are ignored.
    """
    base = spread(pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html")).where(F.col("_html").rlike(r"\S")))
    kind = base.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, tags, texts, sums = [], [], [], [], []
            for i, html in enumerate(batch.column(1).to_pylist()):
                for k, x in enumerate(main_lines(html)):
                    at.append(i)
                    number.append(k)
                    tags.append(x.tag)
                    texts.append(x.text)
                    sums.append(block_md5(x.text))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(tags, pa.string()), pa.array(texts, pa.string()), pa.array(sums, pa.string())], names=[id_col, "block", "tag", "text", "block_md5"])

    return base.mapInArrow(run, f"{id_col} {kind}, block int, tag string, text string, block_md5 string")


def _entry(kinds: frozenset[str]) -> str:
    """A pattern of usual entries; they begin with a capital."""
    return "|".join(f"{e[0].upper()}(?i:{re.escape(e[1:])})" for e in sorted(kinds, key=len, reverse=True))


_SENTENCE_END = re.compile(r"(?<=[.!?…])[”\"»’)\]]*\s+")
_ENTRY = re.compile(rf"(?:{_entry(OPENERS | SHARING)}):?(?=\s+[^\W\d_a-zа-яà-öø-ÿ]|\s*©|\s*$)")
_FLAT_BYLINE = re.compile(r"(?:By|Von|Par|Por|Di|Da|Автор)\s+[^\W\d_]\S*(?:\s+[^\W\d_]\S*){0,3}?,?\s+(?:(?:on|am|le|el|il|em|a)\s+)?\d{1,2}\.?\s+(?:de\s+)?[^\W\d_]+\.?\s+(?:de\s+)?\d{4}(?!\d)")
#: What follows a notice of cookies in its own sentence (fixed values).
_ANSWER = re.compile(r"^(?:accept all|reject all|manage preferences|ok, got it|alle annehmen|alles annehmen|tout accepter|aceptar todo|aceitar tudo|accetta tutto|принять вс[её]|learn more|mehr erfahren|en savoir plus|más información|saiba mais|maggiori informazioni|подробнее)\b.{0,60}$", re.I)
_FOOTER = re.compile(r"^©|rights reserved|rechte vorbehalten|droits réservés|derechos reservados|direitos reservados|diritti riservati|права защищены", re.I)


def _entries_in(piece: str) -> list[tuple[int, int]]:
    """Where usual entries stand in a sentence: at its start or after one another, inside it only several or long ones."""
    found, at = [], [m.span() for m in _ENTRY.finditer(piece) if not m.start() or piece[m.start() - 1].isspace()]
    for k, (a, z) in enumerate(at):
        beside = found and not piece[found[-1][1] : a].strip() or k + 1 < len(at) and not piece[z : at[k + 1][0]].strip()
        word = piece[a:z].rstrip(":").lower()
        alone = a == 0 and (word in OPENERS or not piece[z:].strip() or piece[z:].lstrip()[0] == "©")
        if beside or alone or " " in word:
            found.append((a, z))
    return found


def flat_lines(text: str) -> list[Line]:
    """The lines of a flattened page: sentences, cut also where a menu, an entry, a byline or a notice of rights begins or ends.

    What were tags shows in the words: each word of a menu or entry counts as one, and so does each
    capital of a line that doesn't end as a sentence.
    """
    ends = [m.end() for m in _SENTENCE_END.finditer(text)]
    lines: list[Line] = []

    def add(piece: str, kind: str = "") -> None:
        if piece := piece.strip():
            words = piece.split()
            tags = len(words) if kind in ("menu", "entry", "opener") else 1 if _WHOLE.search(piece) else max(1, sum(w.lstrip("“\"«‘'(")[:1].isupper() for w in words))
            lines.append(Line(piece, tags, 0, (), kind))

    for a, z in zip([0, *ends], [*ends, len(text)], strict=True):
        piece = text[a:z].strip()
        menu = menu_of(piece) if a == 0 else 0
        add(piece[:menu], "menu")
        piece = piece[menu:]
        cuts = [(s, e, "opener" if piece[s:e].rstrip(":").lower() in OPENERS else "entry") for s, e in _entries_in(piece)]
        cuts += [(*m.span(), "byline") for m in _FLAT_BYLINE.finditer(piece)]
        if "©" in piece:
            cuts.append((piece.index("©"), len(piece), "footer"))
        at = 0
        for s, e, kind in sorted(cuts):
            if s >= at:
                add(piece[at:s])
                add(piece[s:e], kind)
                at = e
        add(piece[at:])
    return lines


def _flat_furniture(lines: list[Line], i: int) -> bool:
    x = lines[i]
    return bool(x.hint) or _furniture(x) or bool(_ANSWER.search(x.text)) or len(x.text) < 140 and is_notice(x.text)


def main_text_of_flat(text: str) -> str:
    """The article of a flattened page, by the region rule of its lines.

    Ratios of text to tags are smoothed and lines above the threshold clustered. Openers and notices
    of rights part the page; the clusters of the widest part are the article, with the sentences
    that adjoin them, less the lines that are furniture by what they say.
    """
    lines = flat_lines(text)
    if not lines:
        return ""
    ratios = smoothed_ratios(lines)
    threshold = 0.5 * sum(ratios) / len(ratios)
    furniture = [_flat_furniture(lines, i) for i in range(len(lines))]
    content = [r >= threshold and not f for r, f in zip(ratios, furniture, strict=True)]
    best, start = (0, 0, 0), 0
    for i in range(len(lines) + 1):
        if i == len(lines) or lines[i].hint in ("opener", "footer") or furniture[i] and _FOOTER.search(lines[i].text):
            best = max(best, (sum(len(lines[k].text) for k in range(start, i) if content[k]), start, i))
            start = i + 1
    inside = [k for k in range(best[1], best[2]) if content[k]]
    if not inside:
        return ""
    a, z = inside[0], inside[-1] + 1

    def adjoins(i: int) -> bool:
        return furniture[i] or ratios[i] >= 0.5 * threshold or bool(_WHOLE.search(lines[i].text))

    while a > best[1] and adjoins(a - 1):
        a -= 1
    while z < best[2] and adjoins(z):
        z += 1
    return " ".join(lines[i].text for i in range(a, z) if not furniture[i])


def flat_main_text(records: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, main_text, kept_share) of each record with text, from text without markup."""
    base = spread(records.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").rlike(r"\S")))
    kind = base.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            kept = [main_text_of_flat(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array([len(k) / max(1, len(t)) for k, t in zip(kept, texts, strict=True)], pa.float64())], names=[id_col, "main_text", "kept_share"])

    return base.mapInArrow(run, f"{id_col} {kind}, main_text string, kept_share double")
