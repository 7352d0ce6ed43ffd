"""Sentence boundaries across languages and scripts.

Blank lines cut a text into blocks. In a block every run of terminators, and every smiley, is a candidate; the lattice
of what stands before it (abbreviation, initial, number, enumerator, quotation) and behind it (closing marks, case and
script of the next word) decides. Scripts that write no terminators, or leave them out, are cut at gaps: a lattice over
a dictionary gives the words on both sides, and final particles and opening words decide.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.wordlists import word_list
from spanloom.session import spread

# Abbreviations, lower case and without their last full stop. A full stop behind one of ALWAYS never ends a sentence,
# behind one of NUMBERED not before a number, behind one of SOMETIMES not before a word in lower case or a number.
ALWAYS = frozenset(
    """dr prof mr mrs ms messrs mx rev hon gen col capt lt sgt st ste sr sra srta dra dña ee mme mlle
    dipl med phil priv doz
    e.g i.e vs cf viz approx ca incl excl esp
    z.b d.h u.a z.t s.o s.u bzw vgl ggf evtl sog inkl
    p.ex p.ej ej env av
    т.е т.к т.н т ок см напр им д-р проф акад гр гос ул р ср
    κ κα κκ π.χ π.χ περ βλ πρβλ δρ
    د أ م
    डॉ श्री श्रीमती प्रो कु
    subsp ssp var cv spp sp""".split()
)
NUMBERED = frozenset(
    """fig figs tab tabs abb tabl no nos nr núm n num vol vols suppl p pp pg ch chap sec sect eq eqs ref refs ver v art
    pt exp max min jan feb mar apr jun jul aug sep sept oct nov dec jän okt dez
    рис табл стр с гл εικ πιν σελ αρ चि पृ""".split()
)
SOMETIMES = frozenset(
    """etc al resp jr inc ltd co corp bros dept univ est wk wks mo mos yr yrs hr hrs min mins sec a.m p.m u.s u.k u.s.a
    e.u u.n i.v i.m s.c p.o b.i.d t.i.d q.d ph.d m.d b.sc m.sc d.c usw u.ä u.a.m o.ä др г гг в вв тыс млн млрд проч
    пр ee.uu uu ud uds vd vds κ.λπ κλπ κ.ά μ.μ π.μ वगैरह इत्यादि""".split()
)
# Of these, the ones behind which a number opens a sentence.
OPENED_BY_NUMBER = frozenset("etc resp a.m p.m co inc jr u.s u.k usw u.ä o.ä др пр проч".split())
# Words behind which a single capital letter is a name of a kind and not an initial.
KINDS = frozenset("vitamin hepatitis group type factor grade arm class stage category level appendix section part protein".split())

CLOSERS = "\"'”’»›」』）)】〉》］]}｝〗"
OPENERS = "\"'“‘„‚«‹「『（(【〈《［[{｛〖¿¡"
PAIRED = {"）": "（", ")": "(", "】": "【", "」": "「", "』": "『", "”": "“", "]": "[", "］": "［", "》": "《", "〉": "〈"}
SMILEY = r"(?:[:;][-'^]?[)\](\[DPpOo|/*]+(?![\w])|=[)(D](?![\w])|<3(?!\d)|\^_?\^|[\U0001F300-\U0001FAFF☀-➿][\ufe0f\U0001F3FB-\U0001F3FF]?)"
BLANK_LINE = regex.compile(r"(?:\r\n|\n|\r| )[^\S\n\r]*(?:\r\n|\n|\r| )\s*| ")
UNTERMINATED = r"\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
#: Marks that end a sentence whatever comes next: Arabic and Urdu; Armenian, Ethiopic, Tibetan, Burmese, Khmer, Mongolian, Sinhala,
#: Syriac, N'Ko, Canadian, Lisu, Limbu, Meetei, Javanese, Balinese, Vai.
ENDING = "؟۔" "։።፧፨།༎။។៕᠃᠉෴܀܁܂߹᙮꓿᥄᥅꯫꧈꧉᭞᭟꘎꘏"
TERMINATORS = ".!?…。！？｡．।॥;;‼⁇⁈⁉" + ENDING
CANDIDATE = regex.compile(rf"[{TERMINATORS}]+|{SMILEY}")
#: Blanks in a line of Chinese or Japanese behind what may be a final word.
CJK_GAP = r"(?<=[吗呢吧啊呀啦嘛哦喔すたんうかねよい])[^\S\n\r]+(?=[\p{Han}\p{Hiragana}\p{Katakana}])"
CANDIDATE_OR_GAP = regex.compile(rf"[{TERMINATORS}]+|{SMILEY}|(?<=[{UNTERMINATED}])\s+|\s+(?=[{UNTERMINATED}])|{CJK_GAP}")
HAS_GAPS = regex.compile(rf"[{UNTERMINATED}]|{CJK_GAP}")
#: What a smiley can begin with, besides signs beyond this.
SMILEY_STARTS, PICTURES = ":;=<^", "☀"
MISSING_BLANK = regex.compile(r"(?:\p{Ll}{2}|\p{Lo}\p{M}*|\p{N}|[%)\]”»°])$")
SMILEYS = regex.compile(rf"[^\S\n\r]*{SMILEY}+(?=\s|$|[.!?])")
#: By mark what it closes; opening marks and the straight quote have themselves.
MARK_OF = dict(zip(")）]”»」』》", "(（[“«「『《")) | {mark: mark for mark in "(（[“„«「『《\""}
MARKS = regex.compile(rf"{SMILEY}|[{regex.escape(''.join(MARK_OF))}]")
#: What goes on across terminators: in spaced scripts, and in Chinese and Japanese.
BRACKETED, INSIDE = '(（["“„«', "「『“（(《"
SMILEY_ONLY = regex.compile(SMILEY)
CLOSING = regex.compile(rf"(?:[{regex.escape(CLOSERS)}]|\s*[»›](?=[\s,.;:!?)]|$))+")
WORD_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}'’-]|(?<=\p{L}\p{M}*)\.\s?(?=\p{L}))*")
WORD_END = regex.compile(r"(?r)[\p{L}\p{M}\p{N}]")
#: Longer than any abbreviation, kind or ordinal's word.
LONGEST = 2 * max(map(len, ALWAYS | NUMBERED | SOMETIMES | KINDS)) + 6
GENE = regex.compile(r"(?:\p{Ll}{1,4}\p{Lu}[\p{L}\p{N}]*|\p{Ll}{1,4}-?\p{N}[\p{L}\p{N}]*)(?![\p{L}\p{N}])")
CENSORED = regex.compile(r"\p{L}{1,2}[*#@]{2,}")
TURNS_CASELESS = regex.compile(r"(?:[\p{Latin}\p{N}-]++[ ]?+){1,5}+(?![\p{Latin}])[\p{Lo}]")
NEXT_WORD = regex.compile(r"[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}'’-]*")
CASELESS = regex.compile(r"[\p{Lo}\p{Lm}\p{M}]")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
GREEK_WORD = regex.compile(r"\p{Greek}{2}")
FULL_STOPS = regex.compile(r"[。！？｡．‼⁇⁈⁉।॥]|……")
# What goes on behind a quotation or bracket in Japanese, and who speaks behind one in Chinese.
GOES_ON = regex.compile(r"(?:と|って|という|は|が|を|に|の|も|で|へ|や|から|まで|など|、|，|；|：|的|等)")
# An attribution is in the first or second clause, or ends the sentence with a plain verb of speaking.
SPEAKS = regex.compile(
    r"(?:[^。！？…；：“”「」，,\n]*+[，,])?+[^。！？…；：“”「」，,\n]*?(?:说|說|问|問|道|答|表示|指出|写道)[。，！,]"
    r"|[^。！？…；：“”「」，,\n]*?(?:说|說|问道|問道|答道|表示|指出|写道)[。，！,]|[^。！？…；：“”「」\n]*?(?:说|說|问道|問道|答道|写道)[。！]"
)
ORDINAL_BEFORE = frozenset("der die das dem den des am im vom zum zur beim ab bis seit nach jeder jede jeden ihrer seiner".split())

# Words of the dictionary lattice for a script without terminators, by what they do at a gap.
THAI_OPENING = "ผู้ป่วย แพทย์ พยาบาล อาการ ขนาดยา ขนาด ยา ยานี้ ไม่ ไม่พบ พบ การ ผล ผลการ เรา เขา เธอ คุณ ฉัน ผม มัน แก มึง กู พวก พวกมัน ไอ้ อี นัก ใน_ หาก ถ้า เมื่อ หลัง_ นอกจาก อย่างไรก็ตาม ดังนั้น แต่ มี ควร ห้าม โปรด กรุณา รับประทาน เก็บ ทำไม อะไร ใคร นี่ นี้ ขอ".split()
THAI_GOING_ON = "ของ ใน ที่ ซึ่ง และ หรือ ทุก ทุกวัน วัน วันละ มิลลิกรัม กรัม มิลลิลิตร ราย คน ครั้ง ปี เดือน สัปดาห์ ชั่วโมง นาที บาท เม็ด กับ แก่ ต่อ ด้วย จาก ถึง เพื่อ โดย ว่า คือ เป็น ได้ แล้ว มาก น้อย บาง บางราย ร่วม ระหว่าง หลังจาก หลัง".split()
THAI_FINAL = "วัน มิลลิกรัม กรัม ราย บางราย รุนแรง ไม่ หรือไม่ การรักษา รักษา ทุกวัน ครับ ค่ะ คะ นะ จ้ะ แล้ว เลย ด้วย ไหม มั้ย หรือ สิ ซิ เถอะ ปี เดือน ครั้ง คน ปลอดภัย ดี".split()
THAI_OTHER = "นี้ ปลอดภัย ได้รับ รับ กลับบ้าน กลับ บ้าน ตรวจพบ ตรวจ ไข้ ลดลง ลด ลง เฉลี่ย ข้างเคียง ผลข้างเคียง".split()
# Particles that close what is said, behind which any word opens a sentence that does not join on, and for Lao opening words as for
# Thai. Khmer and Burmese write full stops, so there a gap without a particle is none.
THAI_CLOSING = "ครับ ครับผม ค่ะ คะ นะ นะคะ นะครับ จ้ะ จ๊ะ จ้า ฮะ ขอรับ เถอะ เถิด ไหม มั้ย หรอ เหรอ หรือไม่ หรือเปล่า สิ ซิ น่ะ ล่ะ".split()
THAI_JOINING = "ของ ที่ ซึ่ง และ หรือ ว่า เพื่อ โดย ด้วย คือ แก่ กับ จาก".split()
LAO_CLOSING = "ເດີ ເດີ້ ແດ່ ເນາະ ຈ້າ ບໍ ບໍ່ ດອກ ເທາະ ຫວາ ນໍ ນະ ຄັບ ຄ່ະ".split()
LAO_OPENING = "ຄົນເຈັບ ແພດ ທ່ານໝໍ ພະຍາບານ ອາການ ຂ້ອຍ ຂ້າພະເຈົ້າ ພວກເຮົາ ເຮົາ ລາວ ເຂົາ ເຂົາເຈົ້າ ມັນ ຖ້າ ຫາກ ເມື່ອ ແຕ່ ດັ່ງນັ້ນ ນອກຈາກ ຢາ ການ ຜົນ ບໍ່ ກະລຸນາ ຫ້າມ ຄວນ ຢ່າ".split()
LAO_JOINING = "ທີ່ ແລະ ຫຼື ຂອງ ໃນ ຊຶ່ງ ເຊິ່ງ ກັບ ເພື່ອ ໂດຍ ວ່າ ຈາກ ຕໍ່ ມື້ ຄັ້ງ".split()
KHMER_CLOSING = "ទេ ណា ណា៎ ហ្ន៎ ឬទេ ឬអត់".split()
KHMER_JOINING = "ដែល និង ឬ ព្រោះ ពីព្រោះ ដើម្បី នៃ ក្នុង ជា ពី ដោយ ថា".split()
BURMESE_CLOSING = "တယ် မယ် ပြီ ဘူး လား လဲ နော် ပေါ့".split()
BURMESE_JOINING = "လို့ ဆို ဆိုတာ ဆိုပြီး ဟု ဟူ၍ လည်း နဲ့ ကို မှာ က တွေ".split()
CJK_CLOSING = "吗 呢 吧 啊 呀 啦 嘛 哦 喔 です ます でした ました ません ましょう でしょう ください ですか ますか ましたか ですね ますね ですよ ますよ だよ だね".split()
CJK_JOINING = "と って という が けど けれど けれども ので のに から し ね よ か の は を に も な".split()


class Lattice:
    """Words of a run of script without blanks: the path with the fewest unknown characters, then the fewest words."""

    def __init__(self, dictionary: str, words: list[str]) -> None:
        self.dictionary = dictionary
        self.words = {word.rstrip("_") for word in words}
        self.longest = max(map(len, self.words))

    @lru_cache(1 << 12)  # noqa: B019: lattices are never let go
    def _short(self, run: str) -> list[str]:
        return self._cut(run)

    def cut(self, run: str) -> list[str]:
        return self._short(run) if len(run) <= 200 else self._cut(run)

    def _cut(self, run: str) -> list[str]:
        """The best path; three numbers a character, whatever the length of the run."""
        known, size = word_list(self.dictionary), len(run)
        far = 1 << 40
        unknown, count, back = array("q", [far]) * (size + 1), array("q", [0]) * (size + 1), array("q", [0]) * (size + 1)
        unknown[0] = 0

        def reach(stop: int, cost: int, words: int, at: int) -> None:
            if (cost, words, at) < (unknown[stop], count[stop], back[stop]):
                unknown[stop], count[stop], back[stop] = cost, words, at

        for at in range(size):
            cost, words = unknown[at], count[at] + 1
            reach(at + 1, cost + 1, words, at)
            for stop in range(at + 1, min(size, at + self.longest) + 1):
                if run[at:stop] in self.words:
                    reach(stop, cost, words, at)
            for stop in known.stops(run, at):
                reach(stop, cost, words, at)
        pieces, at = [], size
        while at:
            pieces.append(run[back[at] : at])
            at = back[at]
        return pieces[::-1]


#: By script: the lattice.
LATTICES = {
    "thai": Lattice("thai", THAI_OPENING + THAI_GOING_ON + THAI_FINAL + THAI_CLOSING + THAI_OTHER),
    "lao": Lattice("lao", LAO_OPENING + LAO_JOINING + LAO_CLOSING),
    "khmer": Lattice("khmer", KHMER_JOINING + KHMER_CLOSING),
    "burmese": Lattice("burmese", BURMESE_JOINING + BURMESE_CLOSING),
    "cj": Lattice("cj", CJK_JOINING + CJK_CLOSING),
}
OPENING, GOING_ON, FINAL, JOINING, CLOSING_WORDS = (
    {w.rstrip("_") for w in words if not w.endswith("_")}
    for words in (
        THAI_OPENING + LAO_OPENING,
        THAI_GOING_ON + LAO_JOINING,
        THAI_FINAL,
        THAI_JOINING + LAO_JOINING + KHMER_JOINING + BURMESE_JOINING + CJK_JOINING,
        THAI_CLOSING + LAO_CLOSING + KHMER_CLOSING + BURMESE_CLOSING + CJK_CLOSING,
    )
)
SPACELESS = r"\p{Thai}+|\p{Lao}+|\p{Khmer}+|\p{Myanmar}+|[\p{Han}\p{Hiragana}\p{Katakana}ー]+"
RUN_BEFORE = regex.compile(rf"(?r)(?:{SPACELESS})")
RUN_AFTER = regex.compile(SPACELESS)


def _words(run: str) -> list[str]:
    char = run[0]
    script = "thai" if char < "\u0e80" else "lao" if char < "\u0f00" else "khmer" if "\u1780" <= char < "\u1a00" else "burmese" if char < "\u1100" or "\ua9e0" <= char < "\uab00" else "cj"
    return LATTICES[script].cut(run)


def _gap_ends(text: str, start: int, at: int, stop: int, limit: int) -> bool:
    """Whether white space beside a script without terminators ends the sentence that began at ``start``."""
    left = RUN_BEFORE.match(text, start, at)
    left_words = _words(left.group()) if left else []
    closed = bool(left_words) and left_words[-1] in CLOSING_WORDS
    right = RUN_AFTER.match(text, stop, limit)
    if right:
        first = _words(right.group())[0]
        if closed and first not in JOINING and first not in CLOSING_WORDS - OPENING:
            return True
        if first in OPENING and not (first in GOING_ON):
            # Behind a foreign word or number only a word that cannot go on opens a sentence.
            return True if left_words else len(first) > 2
        return False
    if not left_words:
        return False
    following = NEXT_WORD.match(text, stop, limit)
    if closed:
        return following is not None
    return bool(left_words[-1] in FINAL and following and following.group()[0].isupper() and following.group()[1:2].islower())


def _opens(text: str, at: int, limit: int, before: str) -> bool:
    """Whether what begins at ``at`` can open a sentence behind a word ``before``."""
    skipped = at
    while skipped < limit and text[skipped] in OPENERS:
        skipped += 1
    if skipped >= limit:
        return False
    char = text[skipped]
    if skipped > at:
        return True
    if char.isupper() or char.istitle() or char.isdigit() or CASELESS.match(char):
        return True
    if char.islower():
        if GENE.match(text, at, limit) or CENSORED.match(text, at, limit) or before and CASELESS.match(before[-1:]):
            return True
        return TURNS_CASELESS.match(text, at, limit) is not None
    if char in "-–—•*·#@→":
        follow = _skip(text, skipped + 1, limit)
        return char in "•*#@→" and follow < limit
    return bool(SMILEY_ONLY.match(text, at)) or char.isalnum()


def _word_before(text: str, start: int, at: int) -> regex.Match | None:
    """The word that ends at ``at``, or the last ``LONGEST`` characters of a longer one: no list holds it, and what else is
    asked of a word only its last two characters tell. So chains of initials are not read anew at each of their full stops."""
    return WORD_BEFORE.match(text, max(start, at - LONGEST), at)


def _earlier(text: str, start: int, word: int) -> str:
    """The word before the one that begins at ``word``, in lower case, whatever stands between; empty if there is none."""
    last = WORD_END.search(text, start, word)
    found = _word_before(text, start, last.end()) if last else None
    return found.group().lower() if found else ""


def _abbreviation(text: str, start: int, at: int, after: int, limit: int, spaced: bool) -> bool | None:
    """For a single full stop at ``at``: False if it ends no sentence, True if it does, None if nothing is known."""
    found = _word_before(text, start, at)
    if not found:
        return None
    raw = found.group()
    word = raw.lower().replace(" ", "").replace("\n", "").replace(" ", "").replace(" ", "").replace("’", "'")
    last = word.rpartition(".")[2]
    nxt = text[after : after + 1]
    number = nxt.isdigit() or (nxt in ".(-–" and text[after + 1 : after + 2].isdigit())
    lower = nxt.islower() and not _opens(text, after, limit, "")
    initial = raw[-1].isupper() and (len(raw) == 1 or raw[-2] in ".  \n")
    if initial and not (word in ALWAYS or raw.lower() in SOMETIMES):
        if _earlier(text, start, found.start()) in KINDS:
            return None
        return False if nxt.isalpha() or not spaced else None
    if word in SOMETIMES and (raw.lower() == word or not initial) or last in SOMETIMES and "." not in word:
        if number and OPENED_BY_NUMBER & {word, last}:
            return None
        if number or lower:
            return False
        if last == "г" or word in ("ee.uu", "uu"):
            return None if nxt.isupper() else False
        return None
    if word in ALWAYS or last in ALWAYS and (len(last) > 1 or "." in word):
        return False
    if word in NUMBERED or last in NUMBERED:
        return False if number or lower or nxt in "IVX" and not text[after + 1 : after + 2].islower() else None
    if len(last) == 1 and last.isalpha() and "." in word:  # p. m., т. д.
        return False if lower or number else None
    if f"{word}.{nxt.lower()}" in ALWAYS and text[after + 1 : after + 2] == ".":  # z. B.
        return False
    if len(last) == 1 and CASELESS.match(last) and not CJK.match(last):
        return False
    if raw.isdigit():
        if not text[start : found.start()].strip(" \t\n([") and len(raw) <= 3:
            return False  # an enumerator
        if spaced and nxt.isupper() and len(raw) <= 2 and _earlier(text, start, found.start()) in ORDINAL_BEFORE:
            return False
        if lower:
            return False
    return None


def _skip(text: str, at: int, limit: int) -> int:
    while at < limit and text[at].isspace():
        at += 1
    return at


class Pairs:
    """Brackets and quotations of a block, paired in one sweep when first asked for.

    A closing mark closes the last of its kind that is open; one that closes nothing and one that is never closed do not
    count. A straight quote opens behind white space and closes before it; in between it does what is due.
    """

    def __init__(self, text: str, begin: int, limit: int) -> None:
        self.text, self.begin, self.limit = text, begin, limit
        self.kinds: dict[str, tuple[list[int], list[int], list[int]]] | None = None

    def _sweep(self) -> dict[str, tuple[list[int], list[int], list[int]]]:
        text, begin, limit = self.text, self.begin, self.limit
        opened: dict[str, list[int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for mark in MARKS.finditer(text, begin, limit):
            char, at = mark.group(), mark.start()
            if len(char) > 1 or char not in MARK_OF:
                continue  # a smiley
            opener = MARK_OF[char]
            opens = opener == char
            if char == '"':
                behind_blank = at == begin or text[at - 1].isspace() or text[at - 1] in "([（"
                before_blank = at + 1 == limit or text[at + 1].isspace() or text[at + 1] in ".,;:!?)]）"
                opens = not opened.get(char) if behind_blank == before_blank else behind_blank
                if opens:
                    opened[char] = []  # the one before was never closed
            elif char == "“" and opened.get("„"):
                opener, opens = "„", False
            if opens:
                opened.setdefault(char, []).append(at)
            elif opened.get(opener):
                found.setdefault(opener, []).append((opened[opener].pop(), at))
        kinds = {}
        for opener, spans in found.items():
            spans.sort()
            outer, around = [], []  # for each the pair around it, -1 if there is none
            for place, (at, _) in enumerate(spans):
                while around and spans[around[-1]][1] < at:
                    around.pop()
                outer.append(around[-1] if around else -1)
                around.append(place)
            kinds[opener] = ([at for at, _ in spans], [at for _, at in spans], outer)
        return kinds

    def around(self, start: int, at: int, kinds: str) -> bool:
        """Whether a pair of one of ``kinds`` that opens behind ``start`` is open at ``at``."""
        if self.kinds is None:
            self.kinds = self._sweep()
        for kind in kinds:
            opens, closes, outer = self.kinds.get(kind, ((), (), ()))
            place = bisect_left(opens, at) - 1
            while place >= 0 and opens[place] > start and closes[place] < at:
                place = outer[place]
            if place >= 0 and opens[place] > start:
                return True
        return False


def _block(text: str, begin: int, limit: int, gaps: bool) -> Iterator[tuple[int, int]]:
    start = _skip(text, begin, limit)
    at = start
    search = (CANDIDATE_OR_GAP if gaps else CANDIDATE).search
    pairs = Pairs(text, begin, limit)
    greek: list[int] | None = None
    while True:
        found = search(text, at, limit)
        if not found:
            break
        mark, first, at = found.group(), found.start(), found.end()
        if mark.isspace():
            if first > start and _gap_ends(text, start, first, at, limit):
                yield start, first
                start = at
            continue
        smiley = mark[0] not in TERMINATORS or mark[0] == ";" and mark.strip(";") != ""
        if first == start and not smiley and mark[0] in "….།༎":
            continue  # nothing to end yet
        face = smiley
        stop = at
        closed = ""
        near = text[stop : stop + 1]
        closing = CLOSING.match(text, stop, limit) if near and (near in CLOSERS or near.isspace() or near == "›") else None
        if closing and not smiley:
            closed = closing.group()
            stop = closing.end()
            quote = next((i for i, c in enumerate(closed) if c in "\"'" and text.count(c, start, first) % 2 == 0), None)
            if quote is not None:  # a straight quote with none open before it opens
                closed, stop = closed[:quote], closing.start() + quote
        if text[stop : stop + 1] == "“" and text.rfind("„", start, first) > text.rfind("“", start, first):
            closed, stop = closed + "“", stop + 1
        after = _skip(text, stop, limit)
        while after < limit and (text[after] in SMILEY_STARTS or text[after] >= PICTURES) and (trailing := SMILEYS.match(text, stop, limit)):
            stop, smiley = trailing.end(), True
            after = _skip(text, stop, limit)
        if after >= limit:
            at = limit
            break
        spaced = after > stop
        nxt = text[after]
        last = text[first - 1 : first]
        ends = False
        if nxt in ",;:،؛،、，；：)]}»”’" and not (nxt in ":;" and SMILEY_ONLY.match(text, after)):
            ends = False
        elif mark[0] in ";;" and set(mark) <= {";", ";"}:
            if greek is None:
                greek = [word.start() for word in GREEK_WORD.finditer(text, begin, limit)]
            own = bisect_left(greek, start) < bisect_left(greek, first)
            ends = own and spaced and (nxt.isupper() or nxt in OPENERS or nxt.isdigit() or CASELESS.match(nxt) is not None)
        elif face:
            ends = spaced and _opens(text, after, limit, "") and (nxt.isupper() or nxt.isdigit() or nxt in OPENERS or CASELESS.match(nxt) is not None)
        elif FULL_STOPS.search(mark) or (mark[0] in "…?!" and CJK.match(last)) or closed and CJK.match(text[first - 1 : first]):
            ends = True
            if closed.strip(CLOSERS) == "" and closed:
                opener = PAIRED.get(closed.strip()[-1:], "")
                own = opener and text.rfind(opener, start, first) == start
                bracket = closed.strip()[-1:] in ")）]］】"
                if GOES_ON.match(text, after) and not text[after : after + 2] in ("とて", "もし", "では", "でも", "はい") or SPEAKS.match(text, after):
                    ends = False
                elif bracket and not own and not spaced:
                    ends = False
            elif pairs.around(start - 1, first, INSIDE):
                ends = False
        elif mark[0] in ENDING:
            abbreviated = mark == "។" and text.startswith("ល។", stop)  # ។ល។, and so on
            ends = not abbreviated and (mark[0] in "؟۔" or bool(closed) or not pairs.around(start, first, BRACKETED))
        elif mark in ("…",) or mark.startswith("..") or mark.startswith("…"):
            ends = spaced and _opens(text, after, limit, last) or not spaced and nxt.isupper()
        elif "!" in mark or "?" in mark or mark[0] in "‼⁇⁈⁉":
            if spaced:
                ends = _opens(text, after, limit, last) and not (nxt in "—–-")
            else:
                ends = nxt.isupper() or nxt in "¿¡“«„「" or CJK.match(nxt) is not None or smiley
            if not closed and pairs.around(start, first, BRACKETED):
                ends = False
        else:  # a full stop
            known = None if closed or smiley else _abbreviation(text, start, first, after, limit, spaced)
            if known is False:
                ends = False
            elif spaced:
                ends = _opens(text, after, limit, last)
            else:
                word = NEXT_WORD.match(text, after, limit)
                before = text[max(start, first - 3) : first]
                heads = bool(word) and (nxt.isupper() and (word.group()[1:2].islower() or len(word.group()) == 1 and text[word.end() : word.end() + 1] == " "))
                prior = bool(MISSING_BLANK.search(before)) or len(before) == 3 and before.isupper() or bool(closed)
                ends = prior and (heads or nxt in "¿¡“«„「" or CASELESS.match(nxt) is not None and not last.isdigit() or nxt.isupper() and before.isalpha() and before.islower() and bool(word) and len(word.group()) > 2)
            if ends and not closed and pairs.around(start, first, BRACKETED):
                ends = False
        if ends:
            yield start, stop
            start = at = after
        else:
            at = max(at, stop) if closed or smiley else at
    stop = limit
    while stop > start and text[stop - 1].isspace():
        stop -= 1
    if stop > start:
        yield start, stop


def split_sentences(text: str | None) -> list[tuple[int, int]]:
    """Offsets ``[begin, end)`` in code points of the sentences of a text; none for a null, empty or blank one."""
    if not text:
        return []
    spans: list[tuple[int, int]] = []
    begin = 0
    gaps = HAS_GAPS.search(text) is not None
    for blank in BLANK_LINE.finditer(text):
        spans += _block(text, begin, blank.start(), gaps)
        begin = blank.end()
    spans += _block(text, begin, len(text), gaps)
    return spans


def sentences(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(row_id, begin_pos, end_pos)`` of the sentences of every row; a narrow pass over two columns.

    Whole texts of any length are read in one sweep. Null, empty and blank texts have no sentences; repeated rows and
    null keys are split each like any other; an empty table gives no rows; other columns do not take part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, begins, ends = [], [], []
            for value in batch.column(1):
                spans = split_sentences(value.as_py())
                counts.append(len(spans))
                begins += [span[0] for span in spans]
                ends += [span[1] for span in spans]
            rows = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([rows, pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], names=["row_id", "begin_pos", "end_pos"])

    narrow = documents.select(F.col(key).cast("bigint").alias("row_id"), F.col(text))
    return spread(narrow).mapInArrow(run, "row_id bigint, begin_pos int, end_pos int")
