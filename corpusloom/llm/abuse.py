"""Abusive, hateful and sexually explicit content by a weighted pattern grammar (problem 10).

Spelling is undone first (accents, digits and signs for letters, dots between letters, stretched and
starred letters), quoted words become one mark, and a text is cut into sentences and clauses.  Three transducers
are composed on the fly:

* the lexicon reads words and writes tags with weights: persons and groups (the targets), insults and slurs of
  different strength, harm, doom, elimination, dismissal, explicit terms;
* the grammar reads tags with bounded gaps and adds weights along a path, so that the same word counts little
  alone, more with others, and most when it is aimed at somebody: no single common word is a case;
* the context reads negation, reported speech, and legal, medical and farming words, and takes weight from what follows or surrounds.

A clause has the weight of its best path for each kind of content, a sentence the sum over its clauses, a text
that of its heaviest sentence.
"""
from __future__ import annotations

import itertools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from corpusloom.llm.textform import consistent
from corpusloom.plans.spreading import spread

#: A document with this score or more is a case.
CASE = 2.0
_STEP = 2000

# The lexicon, as tag and phrases, each group after the weight of its phrases.
LEXICON = {
    # targets
    "YOU": "0 mày|chúng mày|tụi mày|bọn mày|lũ mày|mi|you|u|ya|you all|y'all|0 your|ur|mặt mày|nhà mày",
    "ME": "0 tao|tụi tao|bọn tao|bố mày|ông đây|i|im|i'm|we",
    "THEY": "0.3 chúng|chúng nó|bọn nó|bọn chúng|lũ chúng|tụi nó|bọn này|lũ này|they|them|those|these|they all",
    "PEOPLE": "0.6 dân|người|đứa|mấy đứa|mấy thằng|bọn|lũ|cái lũ|cái bọn|bọn dân|lũ dân|people|folk|folks|lot|women|woman|men|kids|judges|tribe|sect|believers|villagers|"
    "0.8 dân tộc|nhập cư|người nhập cư|lũ nhập cư|bọn nhập cư|tị nạn|tàn tật|khuyết tật|đồng tính|da đen|da màu|theo đạo|ngoại đạo|đàn bà|phụ nữ|con gái|gái quê|nhà quê|"
    "immigrant|immigrants|migrant|migrants|foreigner|foreigners|refugee|refugees|jew|jews|muslim|muslims|gay|gays|lesbians|blacks|whites|asians|disabled|gypsies|"
    "1.2 cripples|cripple|bọn pê đê|lũ pê đê|bọn mọi|lũ mọi|bọn ngoại đạo|lũ ngoại đạo",
    # copulas and modals
    "IS": "0.2 là|đúng là|đúng thật là|toàn|toàn là|chỉ là|thật là|quả là|đúng|is|are|am|re|s|was|were|youre|you're|being|0.4 sinh ra đã là|sinh ra là|nothing but|are all|are just",
    "WILL": "0.3 sẽ|mà gặp thì|mà gặp|gặp là|thề|will|ll|gonna|going to|shall|swear|0.3 i'll|ill|we'll",
    "MUST": "0.3 phải|nên|đáng|cần|đáng bị|phải bị|nên bị|must|should|ought to|need to|have to|deserve to|deserve|let's|just",
    "HOPE": "0.5 mong|mong cho|cầu cho|ước gì|cầu trời|hope|wish|pray",
    # insults
    "HEAD": "0.8 đồ|thằng|lũ|thứ|quân|loại|giống|bọn|con mụ|lão|cái đồ|cái thứ|cái lũ|cái thằng|cái bọn|cái loại|mấy thằng|cái giống|con|con mẹ|tụi",
    "VILE": "1.2 ngu|ngu ngốc|ngu si|ngu muội|ngu dốt|ngu xuẩn|đần độn|dốt nát|dốt|điên|điên khùng|khùng|bẩn thỉu|hèn|hèn nhát|bẩn tính|vô dụng|thần kinh|lừa đảo|lười thối|rẻ rách|thối tha|ăn hại|ăn bám|não phẳng|"
    "1.6 khốn|khốn nạn|khốn kiếp|mất dạy|súc vật|súc sinh|vô học|rác rưởi|hèn mạt|hèn hạ|đê tiện|đê hèn|bỉ ổi|đốn mạt|đáng khinh|hạ đẳng|cặn bã|mặt dày|mặt dày mày dạn|vô liêm sỉ|trơ trẽn|lưu manh|mặt người dạ thú|mất nết|mất nhân tính|phản phúc|đáng tởm|"
    "1.1 đĩ|điếm|2.2 chó đẻ|chó chết|chó má|mặt lồn|óc chó|óc lợn|óc bò|óc heo|đầu bò",
    "BRUTE": "1.2 con chó|con lợn|con heo|con bò|con đĩ|con điếm|đồ chó|đồ lợn|thằng chó|lũ chó|con khỉ|con ngu|con điên|2.2 óc chó|óc lợn|óc bò|óc heo|óc trâu|ngu như chó|ngu như bò|ngu như lợn|mặt lợn|chó đẻ|đồ đĩ|con đĩ chó|thằng mặt lồn",
    "ODD": "0.6 dirty|fat|ugly|lazy|lying|rotten|bloody|damn|miserable|sorry|sad little|little|0.9 filthy|disgusting|dumb|vile|goddamn|useless|nasty|slimy|spineless|ignorant|"
    "1.1 stupid|brainless|pathetic|worthless|idiotic|moronic|retarded|1.3 fucking|fuckin|subhuman|shitty|dumbass",
    "LOW": "0.4 dog|dogs|monkey|clown|clowns|0.7 cow|rat|rats|worm|animal|animals|snake|creature|garbage|0.8 pig|pigs|fool|fools|trash|cockroach|cockroaches|swine|creep|jerk|parasite|parasites|savages|savage|"
    "1.1 filth|loser|losers|vermin|idiot|idiots|dimwit|halfwit|weasel|1.5 moron|morons|imbecile|imbeciles|cretin|cretins|bastard|bastards|scum|degenerate|degenerates|subhuman|subhumans|"
    "1.9 scumbag|scumbags|bitch|bitches|whore|whores|slut|sluts|retard|retards|prick|wanker|dipshit|2.3 asshole|assholes|arsehole|motherfucker|motherfuckers|dickhead|fuckwit|cunt|cunts|shithead|son of a bitch|faggot|faggots",
    "PIECE": "1.3 piece of trash|piece of garbage|piece of filth|pile of garbage|waste of air|waste of oxygen|waste of skin|waste of breath|2 piece of shit|piece of crap|0.8 waste of space",
    "OATH": "2.2 địt mẹ|địt con mẹ|đụ má|đụ mẹ|đù má|mẹ kiếp mày|đéo mẹ|dcm|đcm|đkm|vcl|fuck you|fuck off|1.4 con mẹ mày|bố láo|láo toét|screw you|piss off|go to hell|go fuck yourself",
    "AWAY": "0.6 cút|1.3 biến đi|xéo đi|cút đi|cút ngay|cút khỏi|biến khỏi|get lost|crawl back|shut up|slither back|0.8 biến|xéo|"
    "2 cút xéo|cút khỏi đây|cút khỏi mắt|câm mồm|câm họng|câm mõm|ngậm mồm|ngậm mõm|câm cái mồm|khuất mắt tao|cho khuất mắt|cho khuất mắt tao|shut your mouth|shut your face|shut your trap|shut your hole|shut your filthy mouth|shut the fuck up|shut your gob",
    "HOLE": "0.8 hole|cave|sewer|gutter|swamp|đây|khuất|đây ngay|khỏi đây|mắt",
    "SHUT": "0.8 shut|ngậm|câm",
    "MOUTH": "0.5 mouth|face|trap|gob|hole|mồm|mõm|họng",
    "ADDRESS": "0.9 nói cho mày nghe|nói cho mày biết|nghe đây mày|nghe cho rõ đây|mày nghe đây|listen you|hey you|1.1 cái mặt mày|nhìn cái mặt mày|nhìn mặt mày|cái mặt mẹt|cái loại mày",
    # threats
    "HURT": "0.5 cut|0.8 hit|break|burn|smash|shoot|crush|end|find|hurt|slap|punch|bash|chop|tát|đánh|đốt|bắn|đấm|đá|vả|1.5 kill|stab|slit|murder|strangle|rape|behead|slaughter|giết|chém|đâm|đập|bóp cổ|xé xác|xiên|thiêu|cắt cổ|lột da",
    "BODY": "0.8 face|neck|bones|skull|teeth|throat|legs|head|house down|kids|family|mặt|xác|cổ|đầu|chết|nhà|răng|gãy|vỡ mặt|vỡ đầu|chết mẹ|cho chết|chết tươi",
    "PAY": "1.7 biết tay|biết mặt|nhừ đòn|no đòn|nhừ tử|ra bã|một trận|sống không yên|không yên thân|không yên với tao|pay for this|regret|regret it|bleed",
    "DOOM": "1.2 die|dies|died|cancer|dead|death|rot|rots|burn|burns|crash|crashes|raped|murdered|killed|perish|hanged|suffocate|chết|ung thư|tai nạn|chết đi|toi đời|xe cán|tuyệt tự",
    "WISH": "1.8 drop dead|go rot|chết quách|chết quách đi|đi chết|chết mẹ đi|chết con mẹ mày|2.3 go die|go rot somewhere|kill yourself|kill urself|hang yourself|drown yourself|rot in hell|burn in hell|đi chết đi|chết đi cho|chết đi mày|mày chết đi|chết đi cho rồi|go hang yourself|neck yourself",
    "WORTH": "1.9 không đáng sống|không xứng đáng sống|đáng chết|nên chết|không nên tồn tại|deserve to die|deserves to die|should be dead|should die|ought to die|should never have been born|better off dead",
    "STALK": "1.4 know where|biết nhà|biết chỗ|biết mày ở đâu|biết rõ nhà|biết con mày",
    "LIVE": "0.7 live|sleep|park|work|house|kids|school|home|ở|học|làm|đâu|mày",
    "WARN": "1.3 liệu hồn|coi chừng tao|liệu thần hồn|watch your back|your days are numbered|0.6 watch out|coi chừng|giờ hồn|1.9 coi chừng cái mạng|you are next|youre next",
    "MISS": "1.4 nobody would miss|no one would miss|nobody will miss|no one will miss|nobody'd miss|chẳng ai thèm thương|chẳng ai tiếc",
    # hate
    "BEAST": "1.0 animals|a disease|disease|a plague|plague|rats|pigs|dogs|monkeys|apes|trash|garbage|insects|tumour|sâu bọ|chó|lợn|chó ma|bệnh dịch|thú vật|rác|"
    "1.4 vermin|parasites|a cancer|scum|cockroaches|filth|savages|dumb animals|lesser beings|lice|ký sinh trùng|kí sinh trùng|mầm bệnh|sâu mọt|rác rưởi|ung nhọt|mọi rợ|giòi bọ|lũ mọi|man rợ|ung thư của xã hội|"
    "1.8 subhuman|subhumans|subhuman filth|giống hạ đẳng|loài hạ đẳng|loại hạ đẳng|hạ đẳng|súc vật|cặn bã|động vật hạ đẳng|giống súc vật|giống mọi|giống ngu muội",
    "PURGE": "1.1 drive out|round up|get rid of|lock up|driven out|put down|locked up|thrown out|deported|kicked out|shot|beaten|drowned|tống cổ|đuổi|đuổi hết|đuổi sạch|đuổi cổ|nhốt|nhốt hết|nhốt lại|bị nhốt|bị đuổi|bị nhốt lại|cấm cửa|"
    "1.5 wipe out|exterminate|gas|eradicate|exterminated|wiped out|gassed|culled|sterilised|sterilized|castrated|eradicated|burned alive|diệt sạch|giết sạch|giết hết|diệt hết|quét sạch|thiêu sống|xóa sổ|xoá sổ|tiêu diệt hết|thiến hết",
    "SHUN": "0.9 đừng cho chúng|đừng cho bọn|đừng cho lũ|không cho chúng|cấm chúng|đừng thuê|đừng để chúng|keep them out|send them back",
    "SCORN": "1.5 tốn cơm|chỉ tổ tốn cơm|tốn cơm tốn gạo|chết bớt|chết hết đi|chết sạch đi|biết gì mà đòi|biết gì mà|biết cái gì mà|xó bếp|vào bếp mà|go back to your country|belong in a zoo|belong in the kitchen|belongs in the kitchen|belong in cages|belong in a cage|belong in the gutter|breed like rats",
    # explicit
    "SEX": "0.3 video|videos|clip|clips|pics|photos|leaked|0.6 khiêu dâm|khỏa thân|khoả thân|sướng|hạng nặng|nude|naked|hardcore|uncut|strip|lust|tàu nhanh|quằn quại|cả đêm|all night|thâu đêm|hot|nóng bỏng|coins|phòng kín|pornography|"
    "0.9 nứng|uncensored|orgasm|orgasms|porn|làm tình|không che|anal|trần truồng|lộ hàng|clip nóng|ảnh nóng|đi khách|vú|panties|show me your|send me your|topless|moan|moans|moaned|moaning|full hd không che|"
    "1.2 gái gọi|rên rỉ|xem cho sướng|chat sex|sex chat|sex cam|sex show|sex tape|sex video|live sex|phim sex|clip sex|show hàng|khoe hàng|vú to|boobs|boob|horny|xxx|threesome|nudes|begged for more|begging for more|sướng tê|tới bến|phone sex|cam sex|webcam sex|chơi some|đòi thêm|"
    "1.6 tits|pussy|vú khủng|suck me|sucked him|sucked her|sucks him|jerk off|jerked off|jerk me|fuck me|fucked her|fucked me|fucked him|milf|bú mút|lên đỉnh|thủ dâm cho|nứng lồn|2.2 blowjob|blowjobs|handjob|gangbang|creampie|cumshot|deepthroat|bú cu|bú lồn|bú cặc|liếm lồn|địt nhau|chịch|chịch nhau|chịch xoạc|đụ nhau|nứng cặc",
    # context
    "NOT": "1.5 not|never|no|isnt|arent|dont|didnt|isn't|aren't|don't|didn't|wasn't|without|không phải|chẳng phải|đâu phải|không hề|chưa từng|đừng nói|chưa bao giờ",
    "SAID": "2 said|says|say|saying|shouted|shouting|yelled|called|calls|calling|quoted|quotes|wrote|writes|writing|alleged|allegedly|claimed|claims|claim|accused|testified|witness|defendant|the word|the phrase|insult|"
    "chửi|mắng|nói rằng|cho rằng|viết rằng|gọi là|bị cáo|ví dụ|cụm từ|từ ngữ|lời lẽ|phát ngôn|khai rằng|bị tố|câu nói",
    "LAW": "1.5 nghiêm cấm|bị cấm|cấm kỳ thị|bị phạt|phạt tù|xử phạt|truy cứu|hành vi|tố cáo|tội|tòa án|xâm hại|quấy rối|hiếp dâm|cưỡng dâm|mua dâm|bán dâm|gỡ bài|must be removed|fined|fines|prison|offence|offense|offences|punishable|prohibited|unlawful|illegal|harassment|hate speech|convicted|sentenced|rapes|jailed",
    "FARM": "1.5 ruộng|cây trồng|mùa màng|dịch bệnh|côn trùng|nông dân|gia súc|vật nuôi|chuồng trại|chăn nuôi|thuốc trừ sâu|crops|crop|pesticide|livestock|infected|farm|farmers|infestation|infestations",
    "HEALTH": "1 bệnh|bác sĩ|sức khỏe|giáo dục|giới tính|an toàn|bệnh nhân|điều trị|phụ khoa|doctor|doctors|patient|patients|surgery|health|medical|contraception|education|consent|clinic|treatment|therapy|symptoms|exam|breastfeeding|art|museum|painting",
}
# The grammar, as kind of content, weight of the path itself, and tags.  ^ and $ stand for the clause's begin and
# end, ~n for up to n words of any kind, ? for a part that may be absent, * for one that may be
# repeated, + for one that may be repeated anywhere behind.
RULES = [
    ("insult", 0.6, "YOU ~1 IS ~2 HEAD? VILE|BRUTE VILE*"), ("insult", 0.6, "YOU HEAD? VILE|BRUTE $"), ("insult", 0.0, "HEAD VILE VILE*"), ("insult", -0.4, "^ ADDRESS? BRUTE $"),
    ("insult", 0.8, "YOU IS? ~2 ODD* LOW|PIECE"), ("insult", 0.8, "YOU IS ~1 ODD $"), ("insult", 0.2, "ODD ODD* LOW|PIECE"), ("insult", 0.6, "^ ~1 ODD ODD* LOW|PIECE ~1 $"), ("insult", 0.0, "^ YOU? LOW|PIECE $"),
    ("insult", 0.7, "LOW|PIECE|BEAST like YOU"), ("insult", 0.0, "ADDRESS"), ("insult", 0.0, "OATH"), ("insult", 0.0, "ADDRESS ~2 HEAD? VILE|BRUTE"), ("insult", 0.4, "IS ~2 OATH"), ("insult", 0.2, "PEOPLE ~7 BRUTE $"),
    ("insult", 0.0, "AWAY"), ("insult", 0.7, "^ ~1 YOU? AWAY ~2 $"), ("insult", 0.4, "AWAY ~3 YOU ~1 HOLE"), ("insult", 0.3, "AWAY ~2 HOLE"), ("insult", 0.7, "SHUT YOU ODD* MOUTH"),
    ("threat", 0.2, "ME ~1 WILL ~2 HURT ~2 YOU ~1 BODY?"), ("threat", 0.4, "ME ~5 HURT ~3 YOU|BODY BODY?"), ("threat", 0.3, "WILL HURT ~1 YOU BODY?"), ("threat", 0.3, "ME ~2 YOU ~3 PAY"), ("threat", 0.3, "ME ~3 PAY"), ("threat", 0.3, "YOU WILL ~1 PAY"),
    ("threat", 0.0, "WISH"), ("threat", 0.3, "YOU ~2 WORTH"), ("threat", 0.0, "^ WORTH $"), ("threat", 0.4, "HOPE ~2 YOU ~4 DOOM"), ("threat", 0.2, "ME STALK ~1 YOU ~1 LIVE?"), ("threat", 0.3, "STALK YOU LIVE"), ("threat", 0.8, "MISS YOU"),
    ("threat", 0.0, "WARN"), ("threat", 0.0, "WARN ~3 ME STALK ~1 YOU ~1 LIVE?"), ("threat", 0.4, "ADDRESS ~4 HURT"), ("threat", 0.3, "YOU ~2 MUST ~1 WISH"),
    ("hate", 0.3, "PEOPLE|THEY PEOPLE? ~7 IS ~2 ODD? BEAST"), ("hate", 0.3, "PEOPLE ~7 MUST ~3 PURGE"), ("hate", 0.0, "MUST ~2 PURGE"), ("hate", 0.3, "MUST ~2 PURGE THEY"), ("hate", 0.3, "PURGE ~4 THEY|PEOPLE"), ("hate", 0.3, "PEOPLE ~7 IS? ~2 PURGE"),
    ("hate", 0.3, "^ PURGE ~3 $"), ("hate", 0.2, "SHUN"), ("hate", 0.0, "SCORN"), ("hate", 0.3, "PEOPLE ~7 SCORN"), ("hate", 0.4, "IS ~1 BEAST ~2 $"), ("hate", 0.5, "PEOPLE ~3 IS ~1 BEAST"),
    ("sexual", 0.0, "SEX+"),
]
#: Words that a context reaches, and what it is about: negation just before a match, reported speech before it in its sentence.
REACH = {"NOT": 3, "SAID": 14}
LABELS = frozenset(("hỏi", "đáp", "q", "a", "question", "answer"))
EXCUSES = frozenset(("NOT", "SAID", "LAW", "HEALTH", "FARM"))

_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"})
_QUOTED = re.compile(r"“[^”\n]*”|«[^»\n]*»|\"[^\"\n]*\"|„[^“”\n]*[“”]")
_SPELLED = re.compile(r"(?<![^\W_])([^\W\d_](?:[.\-_·][^\W_])+)(?![^\W_])")
_TOKEN = re.compile(r"(?:[^\W_]|[@$*'])+(?:!(?=[^\W\d_]))?(?:[^\W_]|[@$*'])*|▪|[^\s\w@$*]")
_STRETCH = re.compile(r"(.)\1{2,}")
_DOUBLE = re.compile(r"(.)\1+")
_MARKS = dict.fromkeys(c for c in range(0x300, 0x370))


def fold(token: str) -> str:
    """A word without accents."""
    return token if token.isascii() else unicodedata.normalize("NFD", token).translate(_MARKS).replace("đ", "d")


#: Tags that only help: every rule needs another one, so a clause without one has no accepted path.
HELPERS = frozenset("YOU ME THEY PEOPLE IS WILL MUST HOPE HEAD BODY HOLE MOUTH LIVE like NOT SAID LAW HEALTH FARM".split())


class Lexicon:
    """The transducer from words, in any spelling, to tags: ``arcs(tokens)`` gives (tag, end, weight) by place."""

    def __init__(self, lexicon: dict[str, str]):
        self.trie: dict = {}
        self.plain: dict[str, list[str]] = {}  # words as spelled in the lexicon, by their letters without accents
        for tag, text in [*lexicon.items(), ("like", "0 like")]:
            weight = 0.0
            for phrase in text.split("|"):
                first, _, rest = phrase.partition(" ")
                if re.fullmatch(r"[\d.]+", first) and rest:
                    weight, phrase = float(first), rest
                node = self.trie
                for w in phrase.replace("'", "").split(" "):
                    if w not in self.plain.setdefault(fold(w), []):
                        self.plain[fold(w)].append(w)
                    node = node.setdefault(w, {})
                node.setdefault(None, []).append((tag, weight))
        self.by_length: dict[int, list[str]] = {}
        self.squeezed: dict[str, list[str]] = {}
        for w in sorted(self.plain):
            self.by_length.setdefault(len(w), []).append(w)
            self.squeezed.setdefault(_DOUBLE.sub(r"\1", w), []).append(w)
        self.read: dict[str, tuple[str, ...]] = {}
        self.begins = {phrase.replace("'", "").split(" ")[0] for tag, text in lexicon.items() if tag not in HELPERS for phrase in re.sub(r"(?<![^|])[\d.]+ ", "", text).split("|")}
        self.tells: dict[str, bool] = {}

    def may_tell(self, token: str) -> bool:
        """Whether a phrase with a telling tag may begin with the token."""
        known = self.tells.get(token)
        if known is None:
            if len(self.tells) > 500_000:
                self.tells.clear()
            known = self.tells[token] = any(w in self.begins for w in self.readings(token))
        return known

    def readings(self, token: str) -> tuple[str, ...]:
        """The words of the lexicon that a token may stand for; accents that it has must be those of the word."""
        known = self.read.get(token)
        if known is None:
            if len(self.read) > 500_000:
                self.read.clear()
            known = self.read[token] = tuple(dict.fromkeys(self._readings(token)))
        return known

    def _readings(self, token: str) -> list[str]:
        token = token.replace("'", "")
        plain = fold(token)
        if "*" in plain and any(c != "*" for c in plain):
            shape = re.compile(plain.translate(_LEET).replace("*", "."))
            return [w for p in self.by_length.get(len(plain), ()) if shape.fullmatch(p) for w in self.plain[p]]
        found = [plain]
        if not plain.isalpha() and any(c.isalpha() for c in plain):
            found += [plain.translate(_LEET), plain.replace("1", "l").translate(_LEET)]
        for t in list(found):
            if _STRETCH.search(t):
                found += self.squeezed.get(_DOUBLE.sub(r"\1", t), [])
        words = [w for p in found for w in self.plain.get(p, ())]
        if token != plain and plain.isalpha():
            spelled = _DOUBLE.sub(r"\1", token)
            words = [w for w in words if w in (token, spelled)]
        return words

    def arcs(self, tokens: list[str]) -> dict[int, list[tuple[str, int, float]]]:
        read = [self.readings(t) for t in tokens]
        found: dict[int, list[tuple[str, int, float]]] = {}
        for i, readings in enumerate(read):
            nodes = [(self.trie[r], r == tokens[i]) for r in readings if r in self.trie]
            at = i
            while nodes:
                at += 1
                for node, exact in nodes:
                    for tag, weight in node.get(None, ()):
                        # a single word is too weak a sign to excuse anything if its accents are left out
                        if exact or at > i + 1 or tag not in EXCUSES:
                            found.setdefault(i, []).append((tag, at, weight))
                nodes = [(node[r], exact) for node, exact in nodes for r in read[at] if r in node] if at < len(read) else []
        return found


class Grammar:
    """The transducer from tags to kinds of content: states with arcs for tags, for any word, and final weights."""

    def __init__(self, rules):
        self.arcs: list[dict[str, list[int]]] = [{}, {}]  # state 0 starts anywhere, state 1 at a clause's begin
        self.any: list[list[int]] = [[], []]
        self.final: dict[int, list[tuple[str, float, bool]]] = {}
        for kind, weight, pattern in rules:
            self._add(kind, weight, pattern.split())

    def _new(self) -> int:
        self.arcs.append({})
        self.any.append([])
        return len(self.arcs) - 1

    def _add(self, kind: str, weight: float, parts: list[str]) -> None:
        at = {0}
        if parts[0] == "^":
            at, parts = {1}, parts[1:]
        to_end = parts[-1] == "$"
        for part in parts[:-1] if to_end else parts:
            if part[-1] == "+":
                end = self._new()
                for s in {*at, end}:
                    self.arcs[s].setdefault(part[:-1], []).append(end)
                self.any[end].append(end)
                at = {end}
            elif part[0] == "~":
                for _ in range(int(part[1:])):
                    after = self._new()
                    for s in at:
                        self.any[s].append(after)
                    at = at | {after}
            else:
                end = self._new()
                for tag in part.rstrip("?*").split("|"):
                    for s in {*at, end} if part[-1] == "*" else at:
                        self.arcs[s].setdefault(tag, []).append(end)
                at = at | {end} if part[-1] in "?*" else {end}
        for s in at:
            self.final.setdefault(s, []).append((kind, weight, to_end))

    def clause(self, size: int, arcs: dict[int, list[tuple[str, int, float]]], blocked: set[int], denied: dict[int, float]) -> list[tuple[str, float, int]]:
        """(kind, weight, begin) of every accepted path; words in ``blocked`` can't be skipped, those in ``denied`` cost weight."""
        found = []
        states: list[dict[int, tuple[float, int]]] = [{} for _ in range(size + 1)]

        def put(at: int, state: int, weight: float, begin: int) -> None:
            old = states[at].get(state)
            if old is None or weight > old[0]:
                states[at][state] = (weight, begin)

        first = min(arcs)
        for i in range(first, size):
            here = arcs.get(i, ())
            begins = [(0, (0.0, i))] + ([(1, (0.0, i))] if i == 0 else [])
            cost, free = denied.get(i, 0.0), i not in blocked
            for state, (weight, begin) in [*states[i].items(), *(begins if here or i == 0 else ())]:
                table = self.arcs[state]
                if table and here:
                    for tag, end, more in here:
                        if tag in table:
                            for s in table[tag]:
                                put(end, s, weight + more, begin)
                if free:
                    for s in self.any[state]:
                        put(i + 1, s, weight - cost, begin)
            if states[i + 1]:
                self._accept(states[i + 1], i + 1 == size, found)
        return found

    def _accept(self, states: dict[int, tuple[float, int]], at_end: bool, found: list) -> None:
        for state, (weight, begin) in states.items():
            for kind, more, to_end in self.final.get(state, ()):
                if at_end or not to_end:
                    found.append((kind, weight + more, begin))


WORDS, GRAMMAR = Lexicon(LEXICON), Grammar(RULES)
if any(all(p[-1] in "?*" or p[0] in "^$~" or HELPERS & set(p.rstrip("+").split("|")) for p in pattern.split()) for _, _, pattern in RULES):
    raise ValueError("a rule of helping tags only")


def sentences(text: str) -> list[list[list[str]]]:
    """The clauses of each sentence as lower-case tokens with their accents."""
    text = _QUOTED.sub(" ▪ ", consistent(text))
    text = _SPELLED.sub(lambda m: re.sub(r"[.\-_·]", "", m[0]), text.lower()).replace("’", "'")
    found: list[list[list[str]]] = []
    for line in text.split("\n"):
        clauses, clause = [], []
        for token in [*_TOKEN.findall(line), "."]:
            if token[0] == "▪" or token[0].isalnum() or token[0] in "@$*":
                clause.append(token.strip("'"))
            elif token == ":" and clause and clause[-1] in LABELS:  # a new question or answer
                clauses = [*clauses, clause[:-1]] if clause[1:] else clauses
                if clauses:
                    found.append(clauses)
                clauses, clause = [], []
            elif token in ".,;:!?()…–—-/":
                if clause:
                    clauses.append(clause)
                    clause = []
                if token in ".!?…" and clauses:
                    found.append(clauses)
                    clauses = []
    return found


def sentence_score(clauses: list[list[str]]) -> dict[str, float]:
    """The weight of each kind of content in a sentence."""
    total: dict[str, float] = {}
    if not any(map(WORDS.may_tell, itertools.chain.from_iterable(clauses))):
        return total
    lattices = [WORDS.arcs(c) for c in clauses]
    telling = [any(tag not in HELPERS for some in arcs.values() for tag, _, _ in some) for arcs in lattices]
    if not any(telling):
        return total
    around = dict.fromkeys(("LAW", "HEALTH", "FARM"), 0.0)
    for arcs in lattices:
        for tag, _, weight in (x for some in arcs.values() for x in some):
            if tag in around:
                around[tag] = max(around[tag], weight)
    place, said = 0, None  # words so far, and where speech was last reported
    for clause, arcs, tells in zip(clauses, lattices, telling):
        marks = {tag: [(i, end, w) for i, some in arcs.items() for t, end, w in some if t == tag] for tag in REACH}
        best: dict[str, float] = {}
        if tells:
            blocked = {i for i, t in enumerate(clause) if t == "▪"}
            denied = {i: w for i, _, w in marks["NOT"]}
            for kind, weight, begin in GRAMMAR.clause(len(clause), arcs, blocked, denied):
                weight -= max((w for _, end, w in marks["NOT"] if end <= begin <= end + REACH["NOT"]), default=0.0)
                spoken = max((w for _, end, w in marks["SAID"] if end <= begin <= end + REACH["SAID"]), default=0.0)
                if said is not None and place + begin - said <= REACH["SAID"]:
                    spoken = max(spoken, 2.0)
                weight -= spoken
                if weight > best.get(kind, 0.0):
                    best[kind] = weight
        for kind, weight in best.items():
            total[kind] = total.get(kind, 0.0) + min(weight, 4.0)
        if marks["SAID"]:
            said = place + max(end for _, end, _ in marks["SAID"])
        place += len(clause)
    for kind in total:
        total[kind] -= around["LAW"] + (around["HEALTH"] if kind == "sexual" else around["FARM"] if kind == "hate" else 0.0)
    return {k: v for k, v in total.items() if v > 0}


def score(text: str) -> dict[str, float]:
    """The weight of each kind of content in the heaviest sentence of a text."""
    best: dict[str, float] = {}
    for clauses in sentences(text):
        found = sentence_score(clauses)
        if sum(found.values()) > sum(best.values()):
            best = found
    return best


def _scored(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, _STEP):
            part = batch.slice(at, _STEP)
            marks = [score(t) if t else {} for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([round(sum(m.values()), 6) for m in marks], pa.float64()), pa.array([sorted(m) for m in marks], pa.list_(pa.string()))],
                ["key", "score", "kinds"],
            )


def score_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, score, kinds)`` for every row; null and empty texts score 0.  Other columns are not read."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = StructType([rows.schema["key"], StructField("score", DoubleType()), StructField("kinds", ArrayType(StringType()))])
    return spread(rows).mapInArrow(_scored, kind).select(F.col("key").alias(key), "score", "kinds")


def p10_scores(spark, folder: str) -> DataFrame:
    from corpusloom.session import table

    return score_texts(table(spark, folder, "documents"), "doc_id", "text")


def p10_found(spark, folder: str) -> DataFrame:
    return p10_scores(spark, folder).where(F.col("score") >= CASE).select("doc_id")


def p10_rates(spark, folder: str) -> DataFrame:
    """Documents, cases and their rate by source."""
    from corpusloom.session import table

    documents = table(spark, folder, "documents").select(F.struct("doc_id", "source").alias("key"), "text")
    scored = score_texts(documents, "key", "text").select(F.col("key.source").alias("source"), (F.col("score") >= CASE).cast("long").alias("case"))
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.sum("case").alias("cases"), F.round(F.avg("case"), 6).alias("rate"))
