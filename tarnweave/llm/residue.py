"""Template residue, filler, error pages and script notices, by mining message templates.

Every sentence of every record goes down a prefix tree of fixed depth: by its number of tokens,
by its first four and its last three, variable ones (numbers, identifiers, addresses, slots)
masked. A leaf keeps what its messages have in common, position by position, and what is known of
the texts they stand in: how many different texts and hosts, how many texts that are short, of
records with an error status, or beside a message of a known wording. All of this merges in any
order, so each partition grows a tree of its own and leaves are joined afterwards. A leaf is
classified once, and the verdict goes to all sentences that lead to it:

* by its wording, for the usual wordings of filler, errors, notices and furniture;
* whatever its wording, as a message if it recurs in short texts, and mostly in those of records with an
  error status or beside known messages; as furniture if it recurs over many hosts in texts of any kind.

A record is residue if it holds a slot that should have been filled, outside sentences that
write about slots; or a filler sentence; or if error messages and script notices stand where
its content should be. Furniture around the message (menus, notices of rights) isn't content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.llm.samples import spread
from tarnweave.session import cut

DEPTH = 4
#: Leaves that a partition keeps before it hands them on.
LEAVES_KEPT = 200_000
VARIABLE = "<*>"
SLOT = "<slot>"

#: The usual notations of a place that a template fills (fixed formats).
_SLOT = re.compile(
    r"\{\{[^{}]{0,60}\}\}|\$\{[^{}]{0,60}\}|#\{[^{}]{0,60}\}|\{%[^%{}]{0,60}%\}|<%=?[^%<>]{0,60}%>|%%[^%\s]{1,40}%%|\[%[^%\[\]]{0,40}%\]|\[\[[^\[\]]{1,40}\]\]"
    r"|(?<![A-Za-z0-9])__[A-Za-z][\w.]{0,40}?__(?!\w)|@Model\.\w+(?:\.\w+)*|\$\$[^$\s]{1,40}\$\$|\[(?:Insert|Your|Enter|Add) [^\[\]]{1,40}\]|<[^<>]{1,40} goes here>|\{[A-Za-z_][\w.]{1,40}\}"
)
#: Values that a template shows when it got none (fixed values).
_UNSET = re.compile(r"\[object Object\]|\bundefined\b.{0,12}\bNaN\b|\bNaN\b|\bnull null\b|(?<![\w%])%[sd](?!\w)|\bHello null\b")
_SENTENCE = re.compile(r"(?<=[.!?…])[”\"»’)]*\s+")

#: The usual filler words (fixed values, from the classical passage).
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "vivamus sagittis lacus vel augue laoreet rutrum faucibus".split()
)

#: What a sentence of each kind says, as patterns on its lower-cased template (fixed values).
PATTERNS = {
    "mention": r"replaced by the value|the value of a variable|marks a slot|format string|template engine|placeholder syntax|as filler since|is written as",
    "filler": r"is a placeholder|placeholder for|replace this (?:paragraph|text)|sample text|dummy (?:content|text)|for layout only|your (?:headline|text|title|content) (?:goes )?here|goes here|text text text|asdf|qwerty|click edit to|page builder|description coming soon|coming soon,|add your (?:story|text|content) here|\btodo:|heading <\*>|heading 1 heading 2|just another site|platzhalter|texte? (?:de remplissage|d'exemple)|testo segnaposto|texto de (?:relleno|ejemplo|exemplo)|beispieltext|текст-заполнитель|здесь будет",
    "script": r"javascript|(?:enable|activate|disable|switch on|run|need|without|runs?) (?:js|scripts?|scripting)\b|scripts are (?:disabled|off)|scripts to be switched|switch on scripting|turn it on in your browser|instructions for your browser|ad blocker|activate scripts|can(?:'t|not) be (?:shown|displayed|loaded|opened)|doesn't (?:work|load|run)|does not (?:work|load|run)|won't (?:work|load|run)|no funciona|non funziona|não funciona|funktioniert nicht|ne fonctionne|не работает|cookies are (?:blocked|disabled)",
    "error": r"\b(?:error|errore|erreur|erro|fehler|ошибка) (?:<\*>|\d{3})|\b[45]\d\d (?:not found|forbidden|bad gateway|internal server error|service unavailable|gateway timeout)|not found on this server|page you are looking for|we can't find|could not be found|page (?:has|was) moved|no longer exists|page not found|the requested (?:url|page|<\*>)|don't have permission|access (?:denied|to this)|forbidden|session has expired|log in again|something went wrong|try again later|temporarily unavailable|server is (?:busy|down)|down for maintenance|invalid answer|bad gateway|gateway|upstream|establishing a database|database connection|hosting provider|account has been suspended|fatal error|uncaught exception|stack trace|nullpointerexception|exception at|exception in|too many requests|you have been blocked|unusual traffic|that you are a human|security check|captcha"
    r"|check the (?:address|url|spelling)|search box above|wurde nicht gefunden|prüfen sie die|vérifiez l'adresse|compruebe la dirección|confira o endereço|controlla l'indirizzo|проверьте адрес|nicht erreichbar|bitte versuchen|später noch einmal|kann der inhalt nicht|introuvable|indisponible|merci de réessayer|réessayer|no encontrada|no se (?:ha encontrado|encuentra)|no existe|no está disponible|inténtelo|não foi encontrada|indisponível|não está disponível|tente (?:novamente|mais tarde)|non esiste|non (?:è stata trovata|trovata)|non (?:è )?disponibile|riprova|riprovare|не найдена|недоступ|попробуйте|повторите|activate it|(?:allow|turn) them",
    "code": r"^(?:code|ticket|ray|reference|request id|incident|vorgang|código|codice|код|référence)\b.{0,20}$",
    "furniture": r"©|rights reserved|alle rechte vorbehalten|droits réservés|derechos reservados|direitos reservados|diritti riservati|права защищены|правила сайта|(?:^|: )(?:privacy|imprint|terms of use|impressum|datenschutz|nutzungsbedingungen|aviso legal|privacidad|privacidade|note legali|mentions légales|vie privée)\b|cookies?\b|cookie policy|stores small files|your privacy matters|manage preferences|reject all|accept all|ok, got it|newsletter|never miss a story|enter your email|copy link|link kopieren|rundbrief|per mail|рассылку|все или изменить",
}
_KINDS = {k: re.compile(p) for k, p in PATTERNS.items()}


#: Words of the alternatives that begin and end with a choice; a sentence without any hint is of no kind.
_MORE_HINTS = ("js", "script", "cookies", "privacy", "imprint", "terms of use", "impressum", "datenschutz", "nutzungsbedingungen", "aviso legal", "privacidad", "note legali", "mentions légales", "vie privée", "code", "ticket", "ray", "reference", "request id", "incident", "vorgang", "código", "codice", "код", "référence", "error", "erreur", "erro", "fehler", "ошибка", "not found", "forbidden", "bad gateway", "service unavailable", "gateway timeout", " ele", " él", "mehr", "allow them", "turn them", "texte", "texto de", "access ", "©", "asdf", "oops", "todo:")


def _alternatives(pattern: str) -> list[str]:
    """The top-level alternatives of a pattern."""
    out, depth, now, i = [], 0, "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            now += pattern[i : i + 2]
            i += 2
            continue
        depth += (c in "([") - (c in ")]")
        if c == "|" and depth == 0:
            out.append(now)
            now = ""
        else:
            now += c
        i += 1
    return [*out, now]


def _hints() -> ahocorasick.Automaton:
    """Finds a literal that every matching sentence must contain: the longest of each alternative."""
    found = ahocorasick.Automaton()
    for pattern in PATTERNS.values():
        for alternative in _alternatives(pattern):
            rest, before = alternative, ""
            while rest != before:
                before, rest = rest, re.sub(r"\((?:\?:)?[^()]*\)[?*+]?", "\0", rest)
            runs = re.sub(r"\[[^\]]*\][?*+]?|\\.[?*+]?|\.(?:\{[^}]*\}|[?*+])?|.\?|[\^$]", "\0", rest).split("\0")
            literal = max(runs, key=len)
            if len(literal) >= 4:
                found.add_word(literal, literal)
            else:
                assert any(h.strip() in alternative for h in _MORE_HINTS), alternative
    for word in _MORE_HINTS:
        found.add_word(word, word)
    found.make_automaton()
    return found


_HINTS = _hints()


#: Usual entries of a site's menu (fixed values).
MENU = (
    "home|news|shop|forum|search|contact|help|events|topics|archive|newsletter|about us|log in|register|login|sign in|menu|startseite|nachrichten|laden|suche|kontakt|hilfe|termine|themen|archiv|über uns|anmelden"
    "|accueil|actualités|boutique|recherche|aide|agenda|thèmes|archives|à propos|connexion|inicio|noticias|tienda|foro|buscar|contacto|ayuda|temas|archivo|quiénes somos|entrar"
    "|pagina iniziale|notizie|negozio|cerca|contatti|aiuto|eventi|temi|archivio|chi siamo|accedi|página inicial|notícias|loja|fórum|contato|ajuda|eventos|arquivo|sobre nós"
    "|главная|новости|магазин|форум|поиск|контакты|помощь|события|темы|архив|о нас|войти"
)
_MENU_WORDS = frozenset(w for entry in MENU.split("|") for w in entry.split())
_MENU = re.compile(rf"^(?:\S+\s+){{0,3}}?(?:(?:{MENU})\s+){{2,}}", re.I)


def menu_of(sentence: str) -> int:
    """Where the menu ends that a sentence begins with; 0 without one."""
    menu = _MENU.match(sentence) if len(_MENU_WORDS.intersection(sentence.lower().split())) > 1 else None
    return menu.end() if menu else 0


_NAME = re.compile(r"(?:[^\W\d_a-zа-я]\S*\s+){0,3}[^\W\d_a-zа-я]\S*:\s+")


def _after_name(sentence: str) -> list[str]:
    """A sentence that a site or a speaker says, and the name before its colon."""
    name = _NAME.match(sentence)
    return [sentence[: name.end()], sentence[name.end() :]] if name else [sentence]


def messages(text: str) -> list[str]:
    """The sentences of a text; a menu before the first, a name before a colon and a notice of rights are apart."""
    out = _SENTENCE.split(text)
    menu = menu_of(out[0])
    if menu:
        out[:1] = [out[0][:menu], out[0][menu:]]
    if ": " in text:
        out = [part for s in out for part in _after_name(s)]
    if "©" in text:
        out = [part for s in out for part in (s.partition("©")[0], "".join(s.partition("©")[1:]))]
    return [s for s in out if s and not s.isspace()]


_SLOT_SIGN = re.compile(r"[{\[<@]|__|%%|\$\$")
_VARIABLE_SIGN = re.compile(r"[\d/@]")
_STATUS = re.compile(r"[45]\d\d\.?")
_UNSET_SIGN = re.compile(r"NaN|null|undefined|\[object|%[sd]")


def masked(sentence: str) -> list[str]:
    """Tokens of a sentence; what varies from one message to the next is masked."""
    if _SLOT_SIGN.search(sentence):
        sentence = _SLOT.sub(f" {SLOT} ", sentence)
    tokens = sentence.split()
    if _VARIABLE_SIGN.search(sentence):
        return [VARIABLE if _VARIABLE_SIGN.search(t) and not _STATUS.fullmatch(t) else t for t in tokens]
    return tokens


def unfilled(sentence: str) -> int:
    """Places that should have been filled, and values a template shows when it got none."""
    return (len(_SLOT.findall(sentence)) if _SLOT_SIGN.search(sentence) else 0) + (len(_UNSET.findall(sentence)) if _UNSET_SIGN.search(sentence) else 0)


def leaf_of(tokens: list[str]) -> int:
    """The leaf of the prefix tree: number of tokens, the first DEPTH tokens, then the last three."""
    return xxhash.xxh3_64_intdigest("\x1f".join([str(len(tokens)), *tokens[:DEPTH], "", *tokens[DEPTH:][-3:]])) - (1 << 63)


def in_common(a: list[str], b: list[str]) -> list[str]:
    return [x if x == y else VARIABLE for x, y in zip(a, b, strict=True)]


def verdict(template: list[str], example: str) -> str | None:
    """The kind of a template, decided once: what it says about places to fill comes first."""
    shown = example.lower().replace("’", "'")
    words = shown.split()
    own = LOREM.intersection(words)
    if len(own) >= 3 and sum(w.strip(".,;:!?") in LOREM for w in words) >= 0.7 * len(words) and any(len(w) > 4 for w in own):
        return "filler"
    said = " ".join(template).lower().replace("’", "'").replace(SLOT, VARIABLE)
    if next(_HINTS.iter(said), None) is not None:
        for kind in _KINDS:
            if _KINDS[kind].search(said):
                return kind
    elif SLOT in template and _KINDS["mention"].search(shown):
        return "mention"
    return "furniture" if len(_MENU_WORDS.intersection(words)) > 1 and _MENU.match(shown) else None


def is_notice(sentence: str) -> bool:
    """A notice of rights, cookies or letters; writing about cookies isn't one."""
    low = sentence.strip().lower()
    found = _KINDS["furniture"].search(low)
    return bool(found) and not found.group().startswith("cookie")


def known_wording(sentence: str) -> str | None:
    """The kind of a sentence by its own wording, if that is of an error or a script notice."""
    said = sentence.lower().replace("’", "'")
    if next(_HINTS.iter(said), None) is None:
        return None
    kind = next((k for k in _KINDS if _KINDS[k].search(said)), None)
    return kind if kind in ("error", "script") else None


#: A text of so few words can be a message with its furniture and nothing else.
SHORT_WORDS = 60
#: Signs of different texts and addresses (of 64) from which a leaf recurs, and of different hosts from which it is furniture of many.
RECURS, MANY_HOSTS = 3, 16
#: Shares of a leaf's messages that stand in short texts; beside known messages; in records with an error status.
MOSTLY_SHORT, BESIDE, FAILED = 0.8, 0.5, 0.3


def by_company(n: int, short: int, beside: int, failed: int, texts: int, hosts: int, words: int) -> str | None:
    """The kind of a leaf by the texts that its messages stand in; texts and hosts are bit sets of hashes."""
    if words >= 3 and texts.bit_count() >= RECURS and short >= MOSTLY_SHORT * n and (beside >= BESIDE * n or failed >= FAILED * n):
        return "error"
    if hosts.bit_count() >= MANY_HOSTS and short < MOSTLY_SHORT * n:
        return "furniture"
    return None


_LEAF = "leaf long, template string, example string, messages long, short long, beside long, failed long, texts long, hosts long"
_COLUMNS = [c.split()[0] for c in _LEAF.split(", ")]
_SIGN = 1 << 63


def _bit(value: str) -> int:
    return 1 << (xxhash.xxh3_64_intdigest(value) & 63)


def mine_templates(records: DataFrame, text_col: str, status_col: str | None = None, url_col: str | None = None) -> DataFrame:
    """(leaf, template, messages, verdict) of the leaves whose messages are of a kind.

    ``status_col`` has HTTP statuses and ``url_col`` addresses, of which the host counts; either may be missing or
    null, which leaves leaves to their wording and to known messages beside them.
    """

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves: dict[int, list] = {}

        def out() -> pd.DataFrame:
            rows = [(k, "\x1f".join(v[0]), v[1], *v[2:6], *(b - (1 << 64) if b >= _SIGN else b for b in v[6:])) for k, v in leaves.items()]
            leaves.clear()
            return pd.DataFrame(rows, columns=_COLUMNS)

        for pdf in batches:
            for text, failed, host, url in pdf.itertuples(index=False):
                said = messages(text)
                short = len(text.split()) <= SHORT_WORDS
                known = sum(known_wording(s) is not None for s in said) if short else 0
                text_bit, host_bit = _bit(f"{url}\0{text}"), _bit(host)
                for s in said:
                    tokens = masked(s)
                    k = leaf_of(tokens)
                    beside = known > 0 and known > (known_wording(s) is not None)
                    v = leaves.get(k)
                    if v is None:
                        leaves[k] = [tokens, s, 1, int(short), int(beside), int(failed), text_bit, host_bit]
                    else:
                        v[1] = min(v[1], s)
                        if v[0] != tokens:
                            v[0] = in_common(v[0], tokens)
                        v[2] += 1
                        v[3] += short
                        v[4] += beside
                        v[5] += failed
                        v[6] |= text_bit
                        v[7] |= host_bit
            if len(leaves) > LEAVES_KEPT:
                yield out()
        yield out()

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            done = []
            for k, template, example, *sums in pdf.itertuples(index=False):
                tokens = template.split("\x1f")
                if last is not None and last[0] == k:
                    common = last[1] if last[1] == tokens else in_common(last[1], tokens)
                    last = [k, common, min(last[2], example), *(a + b for a, b in zip(last[3:7], sums[:4], strict=True)), last[7] | sums[4], last[8] | sums[5]]
                else:
                    done.append(last)
                    last = [k, tokens, example, *sums]
            yield _judged(done)
        if last is not None:
            yield _judged([last])

    def _judged(rows: list) -> pd.DataFrame:
        found = []
        for r in rows:
            if r is not None:
                kind = verdict(r[1], r[2]) or by_company(*r[3:7], r[7] & (1 << 64) - 1, r[8] & (1 << 64) - 1, len(r[1]))
                if kind is not None:
                    found.append((r[0], " ".join(r[1]), r[3], kind))
        return pd.DataFrame(found, columns=["leaf", "template", "messages", "verdict"])

    failed = F.coalesce(F.col(status_col).cast("int") >= 400, F.lit(False)) if status_col else F.lit(False)
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit("")) if url_col else F.lit("")
    texts = spread(records.select(F.col(text_col).alias("_text"), failed.alias("_failed"), host.alias("_host"), F.coalesce(F.col(url_col), F.lit("")).alias("_url") if url_col else F.lit("").alias("_url")).where(F.col("_text").rlike(r"\S")))
    grown = texts.mapInPandas(grow, _LEAF)
    return grown.repartition("leaf").sortWithinPartitions("leaf").mapInPandas(join, "leaf long, template string, messages long, verdict string")


#: Leaves with a verdict that are sent to every executor; more are joined by a shuffle.
LEAVES_SENT = 500_000


def residue_scores(records: DataFrame, *, id_col: str, text_col: str, status_col: str | None = None, url_col: str | None = None, most_ordinary: int = 0) -> DataFrame:
    """(id, slots, filler, errors, ordinary, residue, reason) of each record with text.

    ``errors``, ``filler`` and ``ordinary`` count sentences; ordinary ones are those of no kind
    with at least five words. reason is 'slot', 'filler', 'error' or 'script', or null. Records
    with null or blank text give no row; null ids are kept; repeated rows of one id are judged
    together; null statuses and addresses say nothing; other columns are ignored.
    """
    templates = cut(mine_templates(records, text_col, status_col, url_col).select("leaf", "verdict"))
    if templates.count() <= LEAVES_SENT:
        templates = F.broadcast(templates)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, leaves, words, slots = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for s in messages(text):
                    owner.append(i)
                    leaves.append(leaf_of(masked(s)))
                    words.append(len(s.split()))
                    slots.append(unfilled(s))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(leaves, pa.int64()), pa.array(words, pa.int32()), pa.array(slots, pa.int32())], names=["_id", "leaf", "words", "slots"])

    base = spread(records.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").rlike(r"\S")))
    kind = base.schema["_id"].dataType.simpleString()
    read_rows = base.mapInArrow(read, f"_id {kind}, leaf long, words int, slots int").join(templates, "leaf", "left")
    v = F.coalesce("verdict", F.lit("ordinary"))

    def count(*kinds: str):
        return F.sum(v.isin(*kinds).cast("int"))

    sums = read_rows.groupBy("_id").agg(
        F.sum(F.when(v == "mention", 0).otherwise(F.col("slots"))).alias("slots"),
        count("filler").alias("filler"),
        count("error").alias("errors"),
        count("script").alias("scripts"),
        F.sum(((v.isin("mention") | ((v == "ordinary") & (F.col("words") >= 5)))).cast("int")).alias("ordinary"),
    )
    message = (F.col("errors") + F.col("scripts") > 0) & (F.col("ordinary") <= most_ordinary)
    reason = F.when(F.col("slots") > 0, "slot").when(F.col("filler") > 0, "filler").when(message & (F.col("errors") >= F.col("scripts")), "error").when(message, "script")
    return sums.select(F.col("_id").alias(id_col), "slots", "filler", (F.col("errors") + F.col("scripts")).alias("errors"), "ordinary", reason.isNotNull().alias("residue"), reason.alias("reason"))
