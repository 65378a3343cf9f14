"""Template residue, filler, error pages and script notices in place of, or beside, real content.

A text is cut into units (sentences, lines). What a unit says is weighed against what its document is about:

* words of pages: things (page, session, server), states (not found, expired, failed), requests to a visitor (reload, enable, log in), words
  of filler (dummy, sample) and of text to be written. No sentence is listed; a unit counts by the classes of its words;
* information: the words left when page words, function words, numbers and the words of title and slug are taken away. A page's message
  has almost none, a sentence that reports on messages ("carers whose session expired reported pain") keeps its own;
* mismatch: a document whose title or slug itself speaks of such things is about them; in any other the unit has nothing to do with title,
  slug and the rest of the body;
* repetition: how many documents of its host, and of the whole collection, hold the unit word for word, numbers aside;
* placeholders, found by their shape, and rows of pseudo-Latin or repeated words.

A placeholder or a row of filler decides alone. A message of two classes and without information counts if it is mismatched or repeated. A
doubtful one (two page words of one class, or as much information as page words) needs mismatch and repetition together. Repetition alone never decides.

One scan: a search for any page word or sign passes most texts by, and only the units of the others are weighed. Only units that wait for
the evidence of hosts are shuffled, as hashes, counted before the shuffle; the counts come back salted, so that no unit gathers in one task.
The evidence, a few small rows for the few texts that have any, is written once and read by each later step.

Defined results. Null, empty and blank texts are no residue. Null titles, slugs and hosts give no evidence; documents without a host are one
host. Each key comes at most once; the same text under two keys is found twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import settled

# Names of fields that record templates hold.
FIELDS = r"abstract|authors?|conclusions?|doi|drug[ _]?name|funding|journal[ _]?name|keywords?|methods?|n[ _]?patients|pmid|primary[ _]?outcome|pub[ _]?date|results?|summary|title"

# How placeholders look, as template languages and editors write them.
PLACEHOLDERS = [
    r"\{\{[^{}\n]{1,60}\}\}",
    r"\{%[^{}%\n]{1,60}%\}",
    r"<%[^<>%\n]{1,60}%>",
    r"\[\[[^\[\]\n]{1,60}\]\]",
    r"<<\s*[A-Za-z][A-Za-z0-9_. -]{1,40}>>",
    r"[$#@]\{[A-Za-z_][A-Za-z0-9_. ]{1,40}\}",
    r"\$[A-Za-z][A-Za-z_]{2,30}\$",
    r"(?<![0-9])%[A-Za-z][A-Za-z_]{2,30}%",
    r"__[A-Za-z][A-Za-z_]{2,30}__",
    r"@@[A-Za-z][A-Za-z_]{2,30}@@",
    r"##[A-Za-z][A-Za-z_]{2,30}##",
    r"\{[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)+\}",
    r"(?i:\{\s*(?:" + FIELDS + r")\s*\})",
    r"(?i:<\s*/?(?:" + FIELDS + r")\s*/?>)",
    r"(?i:<(?:enter|insert|add|your)\s[^<>\n]{1,40}>)",
    r"(?i:\[(?:insert|enter|add|your|insérer|insertar|inserir)\s[^\[\]\n]{1,40}\])",
    r"(?i:\[[^\[\]\n]{1,40}\s(?:to be added|to come|here|einfügen)\])",
    r"(?i:\((?:abstract|methods|results|summary|conclusions?|text|details) (?:to come|to follow|tbd|to be added)\))",
    r"(?i:\b(?:TODO|FIXME|TBD)\b\s*[:-])",
    r"\b(?:FIXME|TODO)\b",
    r"(?i:\bx{4,}\s+insert\b)",
    r"(?i:【\s*(?:" + FIELDS + r")\s*】)",
    r"(?i:&(?:" + FIELDS + r");)",
    r"(?i:%\((?:" + FIELDS + r")\)[sd])",
]

# The words of the common pseudo-Latin filler; and words that fill in nothing but a place.
FILLER_WORDS = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum "
    "eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
)
NONSENSE = "foo|bar|baz|qux|asdf|qwerty|blah|xxx|test|text|todo"

# Words of pages by class, as beginnings of words ("$" ends a whole word), for languages that part words by blanks.
WORDS = {
    # what a page speaks of
    "thing": (
        "page|pages$|webpage|website|site$|sites$|web$|homepage|url|link$|address$|article|abstract$|document$|resource|file$|record$|content|viewer|reader$|browser|javascript|ecmascript|noscript|script$|scripts$|scripting|cookie|"
        "session|server|service$|gateway|proxy|host$|domain|request|query|database|connection|network|index$|node$|account|password|username|captcha|robot|challenge|firewall|permission|access|archive$|portal|key$|code$|status|message|"
        "pointer|object$|config|parameter|header|token|cache|timestamp|instance|viewer|specified|requested|selected|angefordert|solicitad|demandée?|solicitad|запрошен|http|https|api$|ip$|id$|ssl|dns|settings|"
        "seite|webseite|webserver|artikel|inhalt|sitzung|anfrage|zugriff|verbindung|dienst|navigateur|résumé|session|serveur|demande|accès|contenu|connexion|página|sitio|artículo|navegador|sesión|servidor|solicitud|acceso|contenido|conexión|"
        "artigo|resumo$|sessão|acesso|conteúdo|pedido|conexão|solicitação|страниц|сайт|стать|браузер|сесси|сервер|сеанс|запрос|доступ|материал|पृष्ठ|पेज|ब्राउज़र|सर्वर|सत्र|जावास्क्रिप्ट|वेबसाइट"
    ),
    # what is wrong with it
    "state": (
        "error|nosuch|found$|missing|denied|forbidden|refused|blocked|expired|timeout|timed|time-out|failed|failure|fails$|aborted|unavailable|available|disabled|switched|turned|invalid|exception|traceback|null$|undefined|nan$|wrong|unexpected|unexpectedly|"
        "maintenance|offline|down$|overloaded|exceeded|exist$|exists$|unauthorized|unauthorised|authoriz|authoris|bad$|closed?$|removed|moved|deleted|unable|cannot|couldn|support|supported|unsupported|require|required|requires|load$|loaded|delivered|reach$|reached|suspended|"
        "internal|occurr|encountered|interrupted|longer$|limit$|many$|mehr$|existiert|verfügbar|gefunden|fehler|abgelaufen|verweigert|deaktiviert|gesperrt|fehlgeschlagen|wartung|wartungsarbeiten|erreichbar|erforderlich|existe$|supprimé|introuvable|trouvée?|erreur|refusé|expiré|désactivé|indisponible|disponible|maintenance|"
        "encontrad|denegad|caducad|expirad|disponible|deshabilitad|desactivad|mantenimiento|existe$|erro$|negado|disponível|indisponível|desativado|manutenção|ошибк|существует|найден|удал[её]н|недоступн|запрещ|истек|истёк|отключ|отказан|त्रुटि|उपलब्ध|नहीं|अनुपलब्ध|समाप्त|अस्वीकृत|अक्षम"
    ),
    # what a visitor is asked to do, or told
    "request": (
        "please|enable|activate|allow$|allowed|reload|refresh|retry|try$|again$|return|back$|go$|click|continue|log$|logged|login|sign$|contact|check$|checking|verify|human$|prove|solve|wait|sorry|oops|whoops|subscribe|purchase|view$|display|appear|looking|"
        "bitte|aktivieren|aktiviere|erlauben|versuchen|erneut|laden|anmelden|zurück|anzuzeigen|veuillez|activer|activez|autoriser|réessayer|recharger|reconnecter|connecter|retour|afficher|désolé|favor$|active$|habilite|active|intente|intentar|vuelva|recargue|"
        "inicie|volver|tente$|novamente|recarregue|ative$|entre$|пожалуйста|включите|обновите|попробуйте|повторите|вернитесь|войдите|просмотра|извините|कृपया|सक्षम|पुनः|दोबारा|लॉग|वापस|क्षमा"
    ),
    # text that stands for text
    "filler": "placeholder|filler|dummy|sample$|example$|blindtext|platzhalter|beispieltext|fülltext|relleno|exemple|exemplo|provisório|provisional|faux$|mustertext|заполнител|рыба$|प्लेसहोल्डर|नमूना",
    "copy": "text$|texts$|copy$|content|paragraph|abstract|summary|layout|section|headline|texto|texte|text|абзац|текст|पाठ",
    "due": "replace|insert|goes$|here$|appear|supplied|added|written|completed|provided|filled|pending|follow$|authors?$|release|publish|publication|steht|ersetzen|folgt|remplacer|compléter|sustituir|completar|publicar|substituir|preencher|заменит|вставьт|यहाँ",
}

# The same for scripts that part no words, as strings.
STRINGS = {
    "thing": "サーバ|页面|网页|网站|文章|内容|浏览器|脚本|服务器|会话|请求|访问|链接|账号|首页|连接|ページ|サイト|記事|ブラウザ|スクリプト|サーバー?|セッション|リクエスト|アクセス|接続|コンテンツ|หน้า|เว็บ|บทความ|เบราว์เซอร์|สคริปต์|เซิร์ฟเวอร์|เซสชัน|คำขอ|เนื้อหา|javascript|cookie",
    "state": "不存在|被删除|找不到|错误|無法|无法|未找到|过期|拒绝|禁止|失败|不可用|维护|超时|禁用|見つかりません|見つかりませんでした|エラー|拒否|失敗|期限切れ|発生|削除|切れました|無効|利用できません|できません|メンテナンス|停止|ไม่พบ|เกิด|ข้อผิดพลาด|ผิดพลาด|หมดอายุ|ปฏิเสธ|ล้มเหลว|ไม่สามารถ|ไม่พร้อม|ปิดปรับปรุง|ปิดใช้งาน",
    "request": "请|您|启用|开启|重试|返回|刷新|继续|登录|稍后|有効|してください|お探し|申し訳|再度|再読み込み|ログイン|お試し|表示|戻|ต้องการ|กรุณา|โปรด|เปิดใช้งาน|ลองใหม่|อีกครั้ง|กลับ|เข้าสู่ระบบ|รีเฟรช",
    "filler": "占位|示例文字|示例文本|ダミー|サンプル|仮の?テキスト|仮文|ข้อความตัวอย่าง|ตัวอย่างข้อความ",
    "copy": "文本|文字|正文|摘要|テキスト|文章|本文|要旨|ข้อความ",
    "due": "此处|替换|待补充|待定|填写|ここに|入ります|差し替え|入力|ที่นี่|แทนที่",
}

# Words that carry no information of their own.
PLAIN = (
    "a an the this that these those it its of to in on at by for from with without as is are was were be been being am has have had do does did not no nor or and but if when while before after because so than then there here you your we our us i my me he she they them their "
    "will would can could may might must should need needs need's let something nothing anything any some all more most other another side later soon now currently temporarily order run run's time out off up below above only via per into about which what where how s t re went gone "
    "der die das den dem des ein eine einen einem einer und oder nicht ist sind war wird werden wurde um zu im in am an auf für mit von sie ihr ihre ihren diese dieser dieses es bei aus sich hier nach vor "
    "le la les l un une des du de d et ou ne pas est sont ce cet cette ces pour en au aux sur avec vous votre vos nous il elle plus n qu que qui afin à a été être par "
    "el los las un una unos del y o no es son se lo para en con su sus que más por al ha han sido este esta tarde antes "
    "os as um uma do da dos das e ou não é são se para em no na nos nas com seu sua seus mais por foi que este esta antes "
    "и или не на в во для по с со от до из к у вы ваш ваша вас мы это этот эта или как что временно позже была был "
    "के का की को में से पर है हैं यह इस और या करें कर देखने लिए आपका आपके आप"
).split()

_CLASS = {name: re.compile("(?:" + "|".join(w[:-1] + r"\b" if w.endswith("$") else w for w in words.split("|")) + ")") for name, words in WORDS.items()}
_STRING = {name: re.compile(words) for name, words in STRINGS.items()}
_PLAIN = frozenset(PLAIN)
_LETTERS = r"(?:[^\W\d_]+|[\u0900-\u0963]+)+"
_WORD = re.compile(_LETTERS + "(?:['’-]" + _LETTERS + ")*")
_WITHOUT_BLANKS = re.compile("[぀-ヿ㐀-鿿฀-๿]")
_CUT = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？।]+[”’」』）]*\s*|\s(?=<[A-Za-z/])|:\s+(?=\w)")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_MESSAGE, _COPY = ("thing", "state", "request"), ("filler", "copy", "due")
_SHAPE = re.compile("|".join(PLACEHOLDERS))
_ROW = re.compile(r"(?:\b(?:" + "|".join(dict.fromkeys(FILLER_WORDS.split())) + r")\b[\s,.;]*){5,}|(?:\b(?:" + NONSENSE + r")\b[\s,.]*){3,}")
_CODE = re.compile(r"\b[45][0-9]{2}\b")
_NUMBERED = re.compile(r"\w*\d\w*")  # numbers and the ids of requests say nothing
_REMEMBERED = 200_000

# What a text, and then a unit, must hold to be looked at, without look-around: signs of placeholders; words of filler; states, requests and filler text.
_SIGNS = r"\{\{|\{%|<%|\[\[|<<|[$#@]\{|\$[A-Za-z][A-Za-z_]+\$|%[A-Za-z][A-Za-z_]+%|__[A-Za-z]|@@|##|\{\s*[A-Za-z]|<\s*/?[A-Za-z]|\[[^\[\]]{1,50}\]|\((?:abstract|methods|results|summary|conclusions?|text|details) t|\b(?:todo|fixme|tbd)\b|xxxx|【|&[A-Za-z]|%\("
_RARE = r"(?:^|[^\p{L}])(?:consectetur|adipiscing|incididunt|exercitation|ullamco|laboris|aliquip|reprehenderit|voluptate|cillum|pariatur|excepteur|occaecat|cupidatat|deserunt|eiusmod|tempor|aliqua|veniam|nostrud|lorem|ipsum|dolor|dolore|commodo|" + NONSENSE + ")"
_TOLD = ("state", "request", "filler", "due")
_ANCHORS = "(?:^|[^\\p{L}])(?:" + "|".join(w[:-1] + r"(?:\W|$)" if w.endswith("$") else w for name in _TOLD for w in WORDS[name].split("|")) + ")|" + "|".join(STRINGS[name] for name in _TOLD)


def plain(text: str) -> str:
    """The text without invisible characters; lines stay lines, other blanks become one."""
    return re.sub(r"[^\S\n]+", " ", _INVISIBLE.sub("", text))


class Reader:
    """Weighs the units of texts; remembers the classes of words."""

    def __init__(self):
        self.words: dict[str, tuple[str, ...]] = {}

    def classes(self, word: str) -> tuple[str, ...] | None:
        """The classes of a lower-case word, none for a plain word, null for a word with information."""
        if (known := self.words.get(word, False)) is not False:
            return known
        if len(self.words) >= _REMEMBERED:
            self.words.clear()
        core = word[2:] if word[1:2] in ("'", "’") else word  # an elided article or negation
        found = tuple(name for name, beginning in _CLASS.items() if beginning.match(core))
        self.words[word] = known = found or (() if word in _PLAIN or len(word) < 2 else None)
        return known

    def weigh(self, unit: str, about: set[str]) -> tuple[int, int, bool]:
        """(certainty, page words, topical): 2 a message or filler, 1 doubtful, 0 neither; topical if the title speaks of the same things."""
        low = unit.lower()
        seen: set[str] = set()
        page, information, topical, words = 0, 0, False, 0
        if not low.isascii() and _WITHOUT_BLANKS.search(low):
            letters = sum(c.isalpha() for c in low)
            covered = 0
            for name, strings in _STRING.items():
                hits = strings.findall(low)
                if hits:
                    seen.add(name)
                    page += len(hits)
                    covered += sum(map(len, hits))
            words, information = letters / 2, max(0.0, letters - covered) / 6
        else:
            for word in _WORD.findall(_NUMBERED.sub(" ", low)):
                words += 1
                found = self.classes(word)
                if found:
                    page += 1
                    seen.update(found)
                    topical = topical or ("request" not in found and word in about)
                elif found is None and word not in about:
                    information += 1
        coded = "state" in seen and _CODE.search(low) is not None
        message, copy = len(seen.intersection(_MESSAGE)) + coded, len(seen.intersection(_COPY)) if "filler" in seen or seen >= {"copy", "due"} else 0
        if page >= 2 and max(message, copy) >= 2 and (information * 3 <= page or information <= 1 and page >= 2) and information <= 2.5 and words <= 40:
            return 2, page, topical
        if page >= 2 and max(message, copy) >= 1 and information <= page and words <= 40 and ("state" in seen or "request" in seen or copy):
            return 1, page, topical
        return 0, page, topical


def _units(text: str) -> list[str]:
    """Sentences within lines, and across them where a line is wrapped."""
    lines = text.split("\n")
    out = [unit for line in lines for unit in _CUT.split(line)]
    if len(lines) > 1:
        known = set(out)
        out += (unit for unit in _CUT.split(" ".join(lines)) if unit not in known)
    return out


def _signature(unit: str) -> int:
    """A hash of the unit's words, numbers aside."""
    words = " ".join(_WORD.findall(unit.lower())) or unit.lower()
    return int.from_bytes(blake2b(words.encode(), digest_size=8).digest(), "little", signed=True)


def _holds(texts: pa.Array, pattern: str) -> np.ndarray:
    """Rows that match; linear in the text, whatever the number of words."""
    return pc.fill_null(pc.match_substring_regex(texts, pattern, ignore_case=True), False).to_numpy(zero_copy_only=False)


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for batch in batches:
        texts = batch.column(1)
        signs, rare, told = _holds(texts, _SIGNS), _holds(texts, _RARE), _holds(texts, _ANCHORS)
        at = np.flatnonzero(signs | rare | told)
        out: list[tuple] = []
        units: list[str] = []
        owner: list[int] = []
        for k, text in zip(at.tolist(), texts.take(pa.array(at)).to_pylist()):
            seen = plain(text)
            kind = "placeholder" if signs[k] and _SHAPE.search(seen) else "filler" if rare[k] and _ROW.search(seen.lower()) else None
            if kind:
                out.append((k, kind, 3, False, None))
            if told[k]:
                cut = _units(seen)
                units += cut
                owner += [k] * len(cut)
        waiting = np.flatnonzero(_holds(pa.array(units, pa.string()), _ANCHORS)).tolist()
        last, about, marks = -1, set(), set()
        for i in waiting:
            k, unit = owner[i], units[i]
            if k != last:
                last, marks = k, set()
                about = {w for w in _WORD.findall(f"{batch.column(2)[k].as_py() or ''} {batch.column(3)[k].as_py() or ''}".lower()) if len(w) > 3}
            certainty, _, topical = reader.weigh(unit, about)
            if certainty and (mark := _signature(unit)) not in marks:
                marks.add(mark)
                out.append((k, "notice", certainty, topical, mark))
        rows = pa.array([r[0] for r in out], pa.int64())
        columns = [pa.array([r[i] for r in out], kind) for i, kind in ((1, pa.string()), (2, pa.int32()), (3, pa.bool_()), (4, pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(4).take(rows), *columns], ["doc", "host", "kind", "certainty", "topical", "unit"])


#: Documents of one host, and of the collection, from which on a unit is repeated. Parts the counts of a unit are dealt to when they come back.
HOST_REPEATS, REPEATS, SALTS = 3, 6, 32


def evidence(documents: DataFrame) -> DataFrame:
    """(doc, host, kind, certainty, topical, unit): what the units of each document say, over rows of (doc, text, title, slug, host)."""
    types = dict(documents.dtypes)
    rows = documents.select("doc", F.col("text").cast("string"), F.col("title").cast("string"), F.col("slug").cast("string"), F.col("host").cast("string"))
    return rows.mapInArrow(_weigh, f"doc {types['doc']}, host string, kind string, certainty int, topical boolean, unit bigint")


def repetitions(units: DataFrame) -> DataFrame:
    """(unit, host, in_host, everywhere): documents that hold a unit, by host and in all, where it is repeated; null hosts are one host."""
    by_host = units.groupBy("unit", "host").agg(F.countDistinct("doc").alias("in_host"))
    everywhere = by_host.groupBy("unit").agg(F.sum("in_host").alias("everywhere"), F.max("in_host").alias("most"))
    often = everywhere.where((F.col("everywhere") >= REPEATS) | (F.col("most") >= HOST_REPEATS)).select("unit", "everywhere")
    return by_host.join(often, "unit").select("unit", "host", "in_host", "everywhere")


def residue(documents: DataFrame) -> DataFrame:
    """(doc, kind): documents with residue and the kind of their clearest evidence, over rows of (doc, text, title, slug, host).

    Kinds: placeholder, filler, repeated notice (in its host or the collection), lone notice (only by mismatch), repeated fragment (doubtful, but mismatched and repeated).
    """
    found = settled(evidence(documents))
    shaped = found.where("certainty = 3").select("doc", F.when(F.col("kind") == "placeholder", 1).otherwise(2).alias("order"))
    units = found.where("certainty < 3").select("doc", "host", "certainty", "topical", "unit")
    salted = units.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    counts = repetitions(units).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = salted.alias("u").join(counts.alias("c"), (F.col("u.unit") == F.col("c.unit")) & (F.col("u.salt") == F.col("c.salt")) & F.col("u.host").eqNullSafe(F.col("c.host")), "left")
    repeated = F.coalesce((F.col("c.in_host") >= HOST_REPEATS) | (F.col("c.everywhere") >= REPEATS), F.lit(False))
    sure = F.col("u.certainty") == 2
    order = F.when(sure & repeated, 3).when(sure & ~F.col("u.topical"), 4).when(repeated & ~F.col("u.topical"), 5)
    told = met.select(F.col("u.doc").alias("doc"), order.alias("order")).where(F.col("order").isNotNull())
    best = shaped.unionByName(told).groupBy("doc").agg(F.min("order").alias("order"))
    names = F.array(*[F.lit(n) for n in ("placeholder", "filler", "repeated notice", "lone notice", "repeated fragment")])
    return best.select("doc", names[F.col("order") - 1].alias("kind"))
