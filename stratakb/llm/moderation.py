"""Abusive, hateful and sexual content: multiple-instance learning over sentences.

A document is a bag of sentences. Each sentence gets a probability from a logistic model over the
categories of its words, what they have in common, how sober the sentence is, pairs of them, and the
words and word pairs of the labelled sample; a document's score is the noisy-or of its sentences. The
model is fitted to document labels only, through the noisy-or, so it finds the offending sentences by
itself. All weights but the bias have a prior mean of 0: the labels decide what counts, and what
categories have in common carries over to forms and languages that the sample lacks. Words that also
have a sober sense, of animals, plants or the body, are read by their sentence, so that a look-alike
need not be in the sample. Labels that contradict a first fit strongly are left out of the second.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The classifier is fitted to at most this many labelled rows.
MAX_EXAMPLES = 5_000
THRESHOLD = 0.3

# Common words by category, in the languages of the corpus. A word may end in * for the endings below. What a category weighs is learned.
LEXICON = {
    "insult": "idiot* imbecile* imbecil* moron* retard* cretin* halfwit* dickhead* twat* wanker* bastard* bitch* asshole* arsehole* scumbag* dumbass* jackass* turd* prat tosser* bellend* dumbfuck* dipshit* shithead* fuckwit* motherfucker* cunt* prick* douche* douchebag* loser* parasite* pig pigs swine jerk* scum lowlife* whore* slut sluts degenerate* dimwit* numbskull* nitwit* simpleton* maggot* cockroach* vermin weasel leech* coward* clown* liar* creep* faggot* tranny nigger* kike* spic* chink* paki* gook* subhuman* rat rats trash garbage dunce* buffoon* dolt* oaf* hag hags"
    " arschloch arschlöcher hurensohn hurensöhne missgeburt* vollidiot* vollpfosten versager* abschaum drecksau* dreckskerl* schlampe* hure huren wichser* penner* trottel* depp deppen spast* schwachkopf* mistkerl* schwein schweine fotze* miststück* nichtsnutz* dummkopf* idioten sau säue ratte maden drecksack* drecksäcke pfeife* blödmann* blödmänner"
    " salope* connard* connasse* abruti* enculé* larve* imbécile* crétin* ordure* pute putes débile* bouffon* raclure* pourriture* salaud* tocard* conne cons minable* rat vermine charogne* bâtard* blaireau*"
    " imbécil* subnormal* cabrón cabron cabrones cabrona puto puta putos putas inútil* payaso* gilipollas capullo* desgraciad* zorra* perra perras pendej* malparid* escoria estúpid* hijoputa* mamón rata basura bastard* cerdo cerda cerdos tarado* cretino*"
    " 蠢猪 垃圾人 废物 白痴 傻逼 傻比 傻叉 脑残 贱人 贱货 畜生 王八蛋 混蛋 人渣 狗东西 狗杂种 狗娘养 狗屎 杂种 婊子 智障 蠢货 猪头 妓女 骚货 死胖子 败类 蠢驴 饭桶 窝囊废 臭虫",
    "slur_adj": "worthless spineless pathetic filthy brain-dead braindead stupid stinking rotten goddamn lying shitty fucking sorry disgusting miserable smelly clueless brainless vile fat ugly useless dumb retarded dreckig* verdammt* dumm* blöd* elend* hässlich* widerlich* sale sales pauvre minable* nul nulle sucio* asqueroso* maldit* miserable* 肮脏 下贱 恶心",
    "profane": "fuck* shit* crap damn* hell arse ass piss* bollocks bullshit scheiß* scheiss* scheisse verfickt* mist merde* putain bordel foutre mierda* joder coño hostia 他妈的 你妈 操你 草泥马",
    "you": "you your yours yourself u ur du dich dir dein* euch ihr tu toi te ton ta tes vous votre tú ti usted ustedes eres vuestr* follarte matarte quemarte verte violarte romperte pegarte callarte 你 您",
    "hostile": "kys stfu gtfo verreck* crève crevez cállate callate muérete muerete púdrete pudrete revient* revienta lárgate piérdete 去死 不得好死 滚出去 滚开 滚蛋 滚吧 滚回 滚出 闭嘴 狗嘴 死全家",
    "sex": "porn* blowjob* handjob* deepthroat* gangbang* threesome* orgy orgies cumshot* cum creampie* milf* dildo* orgasm* nudes xxx horny pussy pussies tits titties boobs busty undress* nipple* foreplay lingerie panties cock cocks dick dicks penis vagina anal masturbat* erotic* webcam camgirl* escort* strip stripped stripper* naked nude topless bottomless hardcore thighs moan* thrust* slut sluts sexy sexting sex underwear kinky fetish* uncensored naughty raunchy horniest lustful seduc*"
    " ficken fick* gefickt nackt nackte* sexchat sexcam versaut* geil geile* unzensiert* muschi* schwanz möpse titten blasen pornos orgasmus"
    " baiser baise* niquer nue nues chatte* bite bites sodomi* branl* suce* sexe coquine* porno"
    " follar* follarte follame desnud* sexo polla* coño* tetas mamada* corrida* cachond* caliente calientes maduras pornograf* chupa*"
    " 做爱 裸照 脱光 约炮 色情 淫荡 口交 自慰 裸聊 小穴 鸡巴 阴道 肉棒 操逼 激情视频",
    "explicit": "blowjob* handjob* deepthroat* gangbang* cumshot* creampie* porn* camgirl* sexchat sexcam ficken gefickt follar* follarte follame niquer pornos porno pornograf* pornograph* orgasm* masturbat* nudes milf* dildo* 做爱 约炮 裸聊 口交 操逼",
    "group": "women woman girl* female* immigrant* migrant* refugee* foreigner* gays gay lesbian* homosexual* trans transgender* disabled cripple* black* jew* muslim* arab* asian* mexican* gypsies gypsy native* believer* religion faith tribe border skin elderly race races ethnic* christian* hindu* african*"
    " frauen mädchen ausländer* flüchtling* migranten zuwanderer* schwule* lesben homosexuelle* behindert* rollstuhlfahrer* juden muslime* türken araber* schwarze* zigeuner* gläubige* fremde* transsexuelle* senioren rentner greise homos"
    " femmes filles étrangers étrangères immigrés migrants réfugiés pédés gays lesbiennes homosexuels handicapés noirs juifs musulmans arabes vieux vieilles gitans roms croyants trans"
    " mujeres chicas extranjer* inmigrantes migrantes refugiad* maricones maricón gais lesbianas homosexuales discapacitad* negros judíos musulmanes árabes moros viej* gitanos creyentes"
    " 移民 残疾人 外地人 女人 黑人 穆斯林 同性恋 老人 老年人 难民 外国人 少数民族 犹太人 农民工 乡下人 跨性别 信徒 教徒 那个民族",
    "demean": "vermin rat rats subhuman* inferior breed breeding cage cages animals whip whipped sewer* cesspool* cesspit* gutter* stench pest pests mongrel* filth plague criminal* savage* disease* infest* deport* exterminat* eradicat* lynch* hang hanged human dumb stupid trash garbage parasite* scum disgusting filthy hate"
    " abschaum ungeziefer ratten untermenschen menschen dreck blöd dumm pack seuche kriminell* minderwertig* vergasen abschieben"
    " vermine sous-hommes rats cafards racaille sauvages parasites inférieur* dégage* crasse peste"
    " ratas basura plaga alimañas echen échenlos expúls* fuera escoria inferiores salvajes animales cucarachas parásitos"
    " 垃圾 害虫 畜生 人渣 蛀虫 废物 劣等 低等 赶出去 滚 不是人 罪犯 寄生虫 蟑螂 老鼠 不配 下贱",
    "harm": "kill* murder* slit smash* burn* stab stabs stabbed stabbing shoot* hang* strangle* beat* beating whip* bury rape* choke* breathing throat suicide drown* bleed* bullet rot rope ropes noose* gallows gassed behead* bash* punch* skull* throats kneecap*"
    " töten umbringen sterben anzünden verprügeln erschießen abstechen aufhängen schlagen kaltmachen ausschlagen einschlagen zusammenschlagen totschlagen verbrennen vergiften zähne"
    " tuer crever brûler frapper égorger pendre casser buter cogner étrangler noyer massacrer défoncer"
    " matar morir quemar degollar reventar machacar ahorcar ahogar apuñalar golpear mueras revientes pudras"
    " 弄死 打死 砍死 杀了 烧了 捅死 打断 全家 打烂 淹死 烧死 吊死 揍你",
}
# Words of the fields that speak of such things soberly (nature, medicine, teaching, law and rules, language, statistics). How much they excuse is learned.
CONTEXT = frozenset(
    "animal animals dog dogs puppy puppies kennel litter cat cats kitten kittens bird birds hen hens rooster pheasant finch tit duck horse donkey cattle cow cows sheep goat goats fish insect insects species genus breed breeds breeder fur feather nature wildlife zoo farm farmer plant plants flower flowers tree trees willow shrub seed seeds oil garden forest botany zoology biology"
    " health medical medicine clinic clinical hospital doctor doctors nurse nurses patient patients cancer tumour tumor breast screening inspection diagnosis disease diseases symptom symptoms therapy treatment vaccine anatomy organ organs infection virus disorder survivor survivors victims victim help helpline counselling prevention"
    " education educational school schools lesson lessons teacher teachers student students pupil pupils learner learners beginner beginners course courses class lecture university textbook material study studies research survey"
    " policy policies rule rules law laws legal court moderator moderators moderation guideline guidelines report reports reported speech content threat insult violence abuse defines definition term terms glossary dictionary word words phrase title titles tag tags tagged corpus filter filters filtered blocked flagged category filed listed example examples literature novel history museum"
    " tiere tier hund hunde welpen vogel vögel pflanze pflanzen natur gesundheit medizin arzt ärzte pflege patienten krebs vorsorge aufklärung aufklärungsseite unterricht schule schüler lehrer studie regel regeln richtlinie gesetz bericht wort wörter beispiel beispiele begriff hilfe opfer forschung"
    " animaux animal chien chiens chiots oiseau oiseaux plante plantes nature santé médecine médecin infirmière patient patients cancer dépistage éducation école élève élèves cours étude règle règles loi rapport mot mots exemple exemples terme aide victimes recherche classée fiches"
    " animales animal perro perros cachorros ave aves planta plantas naturaleza salud medicina médico enfermera paciente pacientes cáncer educación escuela alumno alumnos curso estudio regla reglas ley informe palabra palabras ejemplo ejemplos término ayuda víctimas investigación fichas".split()
)
CONTEXT_SIGNS = re.compile("教育|健康|医学|医院|医生|护士|患者|癌症|筛查|动物|植物|自然|法律|规则|政策|报告|词语|例子|研究|学生|老师|课程|分类|资料|帮助|受害者")
# Those of them that settle the sense of an animal's or a body's name on their own.
FIELDS = frozenset(
    "animals puppy puppies kennel litter kitten kittens bird birds hen hens rooster pheasant duck horse horses donkey cattle cow cows sheep goat goats fish insect insects species genus breed breeds breeder breeders fur feather feathers wildlife zoo barn farm farmer botany zoology biology"
    " medical medicine clinic clinical hospital doctor doctors nurse nurses patient patients cancer screening diagnosis disease diseases symptom symptoms therapy treatment vaccine anatomy infection infects chromosomes statue sculpture museum painting"
    " tiere stall welpen vögel medizin arzt ärzte patienten krebs animaux chiots oiseaux médecine médecin cancer dépistage animales cachorros aves granja medicina médico cáncer".split()
)
# Words with a sober sense besides (animals, plants, the body): not counted in a sentence aimed at nobody that holds a word of FIELDS or two of CONTEXT.
AMBIGUOUS = frozenset(
    "pussy cock cocks tit tits boobs ass dick prick bitch pig pigs swine rat rats cockroach cockroaches leech leeches parasite parasites weasel maggot maggots vermin pest pests mongrel mongrels whip cum cam penis vagina anal orgasm orgasms masturbation naked nude sex erotic topless thighs stripped thrust wet fetish escort rape suicide retard retarded cripple"
    " schwein schweine sau säue ratte ratten maden ungeziefer seuche schwanz muschi möpse nackt nackte orgasmus"
    " larve vermine rat rats cafards peste chatte nue nues sexe blaireau perra perras zorra cerdo cerda cerdos rata ratas plaga cucarachas parásitos sexo desnudo desnuda".split()
)
# Common idioms of several words by category, separated by bars.
IDIOMS = {
    "hostile": "kill yourself|kill urself|hang yourself|drop dead|go to hell|get lost|piss off|shut up|shut the hell up|shut the fuck up|fuck you|fuck off|screw you|hope you choke|hope you die|hope you rot|hope you burn|hope you suffer|sick of you|tired of you|ashamed of you|disgusted by you|hate you|despise you|curse you|damn you|to hell with you|jump off a|crawl back|crawl away|go die|go and die|go rot|go and rot|know where you live"
    "|halt die fresse|halt die klappe|halt das maul|halt endlich die klappe|halt endlich die fresse|halt deine fresse|halt deine klappe|geh sterben|verpiss dich|leck mich|ta gueule|casse-toi|va te faire|va crever|va mourir|nique ta|vete a la mierda|vete a la verga|vete al infierno|vete al carajo|que te den|cierra la boca|cierra el pico",
    "insult": "good for nothing|son of a bitch|sons of bitches|waste of oxygen|waste of space|waste of skin|piece of shit|piece of crap|piece of garbage|piece of trash|fils de pute|hijo de puta|hijos de puta",
    "group": "old people|those people|that people|these people|people of|people with|people from|alte menschen|alte leute|alten menschen|alten leute|alte sind|die alten",
    "harm": "sink it|sink them|drown them|gas them|" + "|".join(f"{aux} be {done}" for aux in ("should", "should all", "ought to") for done in "put down,shot,hanged,gassed,whipped,beaten,killed,burned,sterilized,sterilised".split(",")),
    "demean": "less than human|not human|no better than|should not exist|no son personas|no sirven|no valen|no merecen|keine menschen|taugen nichts|gehören raus|gehören weg|weg mit|raus mit|an allem schuld|ne servent à|ne valent rien|better off without",
    "sex": "clothes off|come to bed|in bed with|on her knees|on his knees|on your knees|went at it|makes love|make love|spread your legs|suck my|lick my|de rodillas|sin ropa|a cuatro patas|à poil|à quatre pattes|auf die knie|ohne kleider",
}
# Phrases built alike: a category, first words, "..." if up to six words may stand between, and last words; "expel" demeans only a group.
FRAMES = (
    ("expel", "send ship kick throw drive chase get", "...", "back out home"),
    ("expel", "better brighter calmer cleaner freer greater happier healthier nicer prettier purer quieter richer safer stronger", "", "without"),
    ("harm", "partir partirte romper romperte reventar casser péter", "...", "cara dientes piernas huesos boca gueule dents jambes"),
    ("sex", "fuck screw bang lick suck ride spank", "", "me her him"),
    ("sex", "between", "...", "thighs legs"),
    ("sex", "tear tore rip ripped strip take took", "...", "clothes underwear panties bra dress"),
)
IDIOM: dict[str, list[tuple[list[str], str]]] = {}
for _name, _body in IDIOMS.items():
    for _words in map(str.split, _body.split("|")):
        IDIOM.setdefault(_words[0], []).append((_words, _name))
FRAME: dict[str, list[tuple[int, frozenset[str], str]]] = {}
for _name, _first, _gap, _last in FRAMES:
    for _word in _first.split():
        FRAME.setdefault(_word, []).append((6 if _gap else 0, frozenset(_last.split()), _name))
#: Words at which a sentence is looked at more closely.
MARKED = AMBIGUOUS | IDIOM.keys() | FRAME.keys()
#: Endings that a word marked with * may take.
ENDINGS = frozenset(" e en er es ern et est s se st t te ten ter tes n nes ness r rs ed ing ings d ly y ies ied ish ic ical ion ions ation ated ating ate ators a as o os ado ada ados adas ar arse ando ó ía al ales aux eux euse euses e-s é ée és ées ent ant ante ants ait ez ons ung ungen keit lich liche lichen isch ische ischen ity ism ist ists ia ias nd hafte haften in innen uk ers ery eries ty 's s'".split()) | {""}
HARMFUL, TARGETS = ("insult", "slur_adj", "profane", "hostile", "demean", "harm", "sex", "explicit"), ("you", "group")
TARGET_SET = frozenset(TARGETS)
_PAIRS = tuple(f"{a}+{b}" for a, b in itertools.combinations((*HARMFUL, *TARGETS), 2))
#: The bias, what categories have in common (several harmful ones, one with somebody it is aimed at), sober words beside them, each category, and pairs of them.
CONTEXTS = ("context", "context_aimed")
FEATURES = ("bias", "kinds", "kinds_aimed", "aimed", "dense", "sex_many", *CONTEXTS, *HARMFUL, *TARGETS, *_PAIRS)
#: Prior mean of the bias: one sentence in 3,000 without a sign. All other weights have mean 0: without labels nothing is found.
BIAS = -8.0
#: Standard deviations of the priors of the bias, of what categories have in common, of sober words, of single categories, of targets and of pairs.
SCALES = {"bias": 0.3, "common": 3.0, "context": 3.0, "single": 4.0, "target": 0.5, "pair": 2.0}
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕԁһԛԝкмтвнзьАЕОРСУХІЈЅВКМНТαεορτυικνχΑΒΕΖΗΙΚΜΝΟΡΤΥΧɑɡıǃ",
    "aeopcyxijsdhqwkmtbh3bAEOPCYXIJSBKMHTaeoptuikvxABEZHIKMNOPTYXagi!",
)
INVISIBLE = re.compile(r"[​-‏‪-‮⁠-⁤﻿­᠎︀-️]")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][.\-_·•*~ ]){2,}[^\W\d_](?![^\W_])")
LEET = re.compile(r"(?<![^\W_])(?=[^\s]*[a-z])(?=[^\s]*[0-9$@!|+€])[a-z0-9$@][a-z0-9$@!|+€*]+[a-z0-9$](?![^\W_])")
LEET_MAP = str.maketrans("013457$@!|+€", "oieastsaiite")
STARS = re.compile(r"(?<![\w*])[^\W\d_]+(?:\*+[^\W\d_]+)+(?![\w*])|(?<![\w*])[^\W\d_]{2,}\*{2,}(?![\w*])")
RUNS = re.compile(r"([^\W\d_])\1{2,}")
SPLIT = re.compile(r"(?<=[.!?。！？…])(?=\s|[^\s.!?。！？…])\s*|\n+")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
CJK = re.compile(r"[一-鿿]")
CJK_RUN = re.compile(r"[一-鿿]{2,}")


def _lexicon() -> tuple[dict[str, set[str]], dict[str, set[str]], dict[str, set[str]]]:
    whole: dict[str, set[str]] = {}
    stems: dict[str, set[str]] = {}
    signs: dict[str, set[str]] = {}
    for name, body in LEXICON.items():
        for word in body.split():
            if CJK.match(word):
                signs.setdefault(word, set()).add(name)
            elif word.endswith("*"):
                stems.setdefault(word[:-1], set()).add(name)
            else:
                whole.setdefault(word, set()).add(name)
    return whole, stems, signs


WHOLE, STEM, SIGN_WORDS = _lexicon()
STEM_LENGTHS = sorted(set(map(len, STEM)))
ANY_CJK = re.compile("|".join(sorted(SIGN_WORDS, key=len, reverse=True)))


class _Categories(dict):
    """Word to its lexicon categories; emptied when it holds a million words."""

    def __missing__(self, word: str) -> frozenset[str]:
        found = set(WHOLE.get(word, ()))
        for n in STEM_LENGTHS:
            if n > len(word):
                break
            if word[:n] in STEM and word[n:] in ENDINGS:
                found |= STEM[word[:n]]
        if len(self) > 1_000_000:
            self.clear()
        got = self[word] = frozenset(found)
        return got


CATEGORIES = _Categories()


def _starred(match: re.Match) -> str:
    """A word whose letters were hidden behind stars, if the lexicon has one that fits."""
    word = match.group(0)
    pattern = re.compile(re.escape(word).replace(r"\*", "[^\\W\\d_]"))
    loose = re.compile(re.sub(r"(\\\*)+", "[^\\\\W\\\\d_]{1,8}", re.escape(word)))
    for test in (pattern, loose):
        for known, kinds in (*WHOLE.items(), *sorted(STEM.items())):
            if len(known) >= 4 and kinds & {"insult", "profane", "sex", "demean"} and test.fullmatch(known):
                return known
    return word


class _Signs(dict):
    """Token to what may have to be undone in it: 1 stretched letters, 2 digits for letters, 4 stars, 8 single letters."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[token] = bool(RUNS.search(token)) | 2 * bool(LEET.search(token)) | 4 * ("*" in token and bool(STARS.search(token))) | 8 * bool(len(re.sub(r"\W|_", "", token)) == 1 or SPACED.search(token))
        return got


SIGNS = _Signs()


def canonical(text: str) -> str:
    """Lower case with look-alike letters, letter spacing, digits for letters, stars and stretched letters undone."""
    text = INVISIBLE.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = re.sub(r"(?<=[a-zA-Z])[Ѐ-ӿͰ-ϿԀ-ԯɑɡ]+|[Ѐ-ӿͰ-ϿԀ-ԯɑɡ]+(?=[a-zA-Z])", lambda m: m.group(0).translate(HOMOGLYPHS), text)
    text = text.lower()
    signs = 0
    for sign in map(SIGNS.__getitem__, text.split()):
        signs |= sign
    if signs & 8:
        text = SPACED.sub(lambda m: re.sub(r"[^\w]|_", "", m.group(0)), text)
    if signs & 4:
        text = STARS.sub(_starred, text)
    if signs & 2:
        text = LEET.sub(lambda m: m.group(0).translate(LEET_MAP), text)
    return RUNS.sub(r"\1", text) if signs & 1 else text


def sentences(text: str) -> list[str]:
    return [s for s in SPLIT.split(text) if s and not s.isspace()]


def sobriety(sentence: str, words: list[str]) -> int:
    """The number of different words of CONTEXT in a canonical sentence."""
    return len(CONTEXT.intersection(words)) + (0 if sentence.isascii() else len(set(CONTEXT_SIGNS.findall(sentence))))


def features(sentence: str, words: list[str]) -> dict[str, float]:
    """The lexicon features of a canonical sentence, without the bias."""
    found: set[str] = set()
    sexual: set[str] = set()
    dense = 0.0
    marked = not MARKED.isdisjoint(words)
    sober = marked and not AMBIGUOUS.isdisjoint(words) and (not FIELDS.isdisjoint(words) or sobriety(sentence, words) >= 2) and not any(CATEGORIES[w] & TARGET_SET for w in words)
    for w in words:
        kinds = CATEGORIES[w]
        if kinds and not (sober and w in AMBIGUOUS):
            found |= kinds
            dense += (not kinds <= TARGET_SET) / len(words)
            if "sex" in kinds:
                sexual.add(w)
    if not sentence.isascii() and CJK.search(sentence):
        for w in ANY_CJK.findall(sentence):
            found |= SIGN_WORDS[w]
            dense += (not SIGN_WORDS[w] <= TARGET_SET) * len(w) / len(sentence)
            if "sex" in SIGN_WORDS[w]:
                sexual.add(w)
    if marked:
        for i, w in enumerate(words):
            for idiom, name in IDIOM.get(w, ()):
                if words[i : i + len(idiom)] == idiom:
                    found.add(name)
                    dense += (name not in TARGET_SET) * len(idiom) / len(words)
                    if name == "sex":
                        sexual.add(" ".join(idiom))
        for i, w in enumerate(words):
            for gap, last, name in FRAME.get(w, ()):
                for x in words[i + 1 : i + 2 + gap]:
                    if x in last:
                        if name == "expel" and "group" not in found:
                            break
                        found.add("demean" if name == "expel" else name)
                        dense += 2 / len(words)
                        if name == "sex":
                            sexual.add(f"{w} {x}")
                        break
    if "demean" in found and found.isdisjoint(TARGET_SET):  # such words demean only with somebody they are said of
        found.discard("demean")
    if not found:
        return {}
    harm, aimed = [c for c in HARMFUL if c in found], any(c in found for c in TARGETS)
    out = dict.fromkeys(found, 1.0)
    if harm:
        out["dense"] = min(dense, 1.0)
        out["kinds"] = float(min(len(harm), 4) - 1)
        if aimed:
            out["aimed"] = 1.0
            out["kinds_aimed"] = out["kinds"]
        if context := sobriety(sentence, words):
            out["context"] = float(min(context, 4))
            if "you" in found:
                out["context_aimed"] = out["context"]
    if len(sexual) >= 2:
        out["sex_many"] = float(min(len(sexual) - 1, 3))
    for pair in itertools.combinations([c for c in (*HARMFUL, *TARGETS) if c in found], 2):
        out["+".join(pair)] = 1.0
    return out


def grams_of(sentence: str, words: list[str]) -> list[str]:
    """Words, word pairs, and pairs of Chinese characters of a canonical sentence."""
    out = words + list(map(" ".join, zip(words, words[1:])))
    if not sentence.isascii():
        for run in CJK_RUN.findall(sentence):
            out += map("".join, zip(run, run[1:]))
    return out


@dataclass
class Model:
    """Weights of the lexicon features, and of the words and word pairs of the labelled sample."""

    weights: np.ndarray
    grams: dict[str, float]
    lexicon: bool = True

    def logits(self, text: str) -> list[float]:
        w = dict(zip(FEATURES, map(float, self.weights)))
        get, bias = self.grams.get, w["bias"]
        out = []
        for s in sentences(canonical(text)):
            words = WORD.findall(s)
            z = bias
            if known := self.grams.keys() & grams_of(s, words):
                z += sum(map(get, known))
            if self.lexicon:
                z += sum(v * w[f] for f, v in features(s, words).items())
            out.append(z)
        return out


def noisy_or(logits: list[float]) -> float:
    """1 - product of (1 - p) over sentences; 0 for a text without any."""
    if not logits:
        return 0.0
    z = np.clip(np.array(logits), -60, 60)
    return float(-np.expm1(-np.logaddexp(0, z).sum()))


def fit(texts: list[str], labels: list[int], rounds: int = 400, gram_scale: float = 0.5, step: float = 0.25, least: int = 1, lexicon: bool = True) -> Model:
    """Fit the model to document labels through the noisy-or, by gradient ascent with momentum.

    gram_scale is the standard deviation of the Gaussian prior of words and word pairs, SCALES has those
    of the lexicon features; all but the bias have mean 0. Rows with a null label or a blank text must
    be left out before; without rows the prior is the model, which finds nothing. Without `lexicon`
    only words and word pairs are learned.
    """
    names = {f: i for i, f in enumerate(FEATURES)}
    vocabulary: dict[str, int] = {}
    bags: list[list[tuple[list[int], list[float]]]] = []
    seen: dict[str, int] = {}
    parsed = []
    for text in texts:
        rows = []
        for s in sentences(canonical(text)):
            words = WORD.findall(s)
            rows.append((features(s, words) if lexicon else {}, grams_of(s, words)))
        parsed.append(rows)
        for g in {g for _, grams in rows for g in grams}:
            seen[g] = seen.get(g, 0) + 1
    for g, n in seen.items():
        if n >= least:
            vocabulary[g] = len(FEATURES) + len(vocabulary)
    for rows in parsed:
        bag = []
        for found, grams in rows:
            index, value = [0], [1.0]
            for f, v in found.items():
                index.append(names[f])
                value.append(v)
            for g in set(grams):
                if g in vocabulary:
                    index.append(vocabulary[g])
                    value.append(1.0)
            bag.append((index, value))
        bags.append(bag)
    size = len(FEATURES) + len(vocabulary)
    prior = np.zeros(size)
    prior[0] = BIAS
    scale = np.full(size, gram_scale)
    scale[: len(FEATURES)] = [SCALES["bias" if f == "bias" else "context" if f in CONTEXTS else "pair" if "+" in f else "single" if f in HARMFUL else "target" if f in TARGETS else "common"] for f in FEATURES]
    inverse = 1 / scale**2
    flat = [(d, i, v) for d, bag in enumerate(bags) for i, v in bag]
    doc = np.array([d for d, _, _ in flat], int)
    rows = np.repeat(np.arange(len(flat)), [len(i) for _, i, _ in flat]) if flat else np.array([], int)
    cols = np.array([x for _, i, _ in flat for x in i], int)
    vals = np.array([x for _, _, v in flat for x in v])
    y = np.array(labels, float)
    weight = np.ones(len(y))

    def loss_of(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.bincount(rows, vals * w[cols], len(flat)) if len(flat) else np.array([])
        soft = np.logaddexp(0, z)  # -log(1 - p) of a sentence
        total = np.maximum(np.bincount(doc, soft, len(y)), 1e-12)
        return z, total, np.where(y > 0, -np.log(-np.expm1(-total)), total)

    w = prior.copy()
    for again in range(2):  # words that one text has alone explain its label in the second fit only
        inverse[len(FEATURES) :] = (3.0 if again == 0 else 1.0) / gram_scale**2
        w, speed = prior.copy(), np.zeros(size)
        square = np.full(size, 1e-3)
        for _ in range(rounds if len(flat) else 0):
            z, total, _ = loss_of(w)
            slope = np.where(y > 0, 1 / np.expm1(np.minimum(total, 50)), -1.0) * weight  # of the log likelihood by total
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            g = np.bincount(cols, (slope[doc] * p)[rows] * vals, size) - inverse * (w - prior)
            speed = 0.9 * speed + 0.1 * g
            square = 0.99 * square + 0.01 * g * g
            w = w + step * speed / np.sqrt(square + 1e-6) * 0.2
        if again == 0 and len(flat):  # labels that contradict the fit
            _, _, loss = loss_of(w)
            weight = (loss < 3.0).astype(float)
    return Model(w[: len(FEATURES)], {g: float(w[i]) for g, i in vocabulary.items() if abs(w[i]) > 1e-3}, lexicon)


def train(examples: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """Fit to at most max_examples labelled rows (text, label) of examples; null labels and blank texts are left out."""
    rows = examples.where("label is not null and length(trim(text)) > 0").select("text", "label")
    sample = rows.orderBy(F.xxhash64("text"), "text", "label").limit(max_examples).collect()
    return fit([r["text"] for r in sample], [int(r["label"]) for r in sample])


def score(documents: DataFrame, model: Model, key: str = "doc_id", keep: str | None = None) -> DataFrame:
    """(key, score, sentence, sentence_no, sentence_score) of every row of documents, and the string column `keep`.

    sentence is the most offending one, sentence_no its number from 1; null and blank texts score 0
    and have none. Rows keep their number. Texts are read whole.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for k, text, kept in zip(frame["key"], frame["text"], frame["kept"]):
                z = model.logits(text) if text and not text.isspace() else []
                if not z:
                    out.append((k, 0.0, None, None, None, kept))
                    continue
                worst = int(np.argmax(z))
                out.append((k, noisy_or(z), sentences(canonical(text))[worst] if z[worst] > 0 else None, worst + 1 if z[worst] > 0 else None, float(1 / (1 + np.exp(-max(z[worst], -60.0)))), kept))
            yield pd.DataFrame(out, columns=["key", "score", "sentence", "sentence_no", "sentence_score", "kept"]).astype({"sentence_no": "Int32"})

    df = documents.select(F.col(key).alias("key"), F.col("text"), (F.col(keep) if keep else F.lit(None)).cast("string").alias("kept"))
    out = df.mapInPandas(run, f"key {kind}, score double, sentence string, sentence_no int, sentence_score double, kept string").withColumnRenamed("key", key)
    return out.withColumnRenamed("kept", keep) if keep else out.drop("kept")
