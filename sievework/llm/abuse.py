"""Abusive, hateful or sexual content: a calibrated score for every text.

A text is cut into sentences. Each sentence, after disguises are undone, becomes a row of dense features:
densities of the lexica, how near the second person is, capitals, punctuation, rate of disguise, hints of
technical, medical or everyday senses. Gradient-boosted trees score the row, isotonic regression turns the
score into a probability, and a text has the probability of its worst sentence. Trees and calibration are
fitted on labelled sentences made here from own templates, see ``examples``; their number is the parameter
``sample`` (default 12,000). Every text is scored over its whole length.

Defined cases: null, empty and blank texts score 0. Repeated texts are scored once per batch.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import boosting
from sievework.llm.lookalike import comparison

THRESHOLD = 0.5

# Lexica, accents stripped and lower case; a trailing * stands for any ending.
LEXICA: dict[str, str] = {
    "insult": """idiot idiots idiotic moron morons moronic jerk jerks bastard bastards loser losers clown clowns cretin cretins imbecile imbeciles halfwit halfwits scumbag* asshole* arsehole*
        dumbass* dipshit* dickhead* fuckwit* fucker* motherfucker* shithead* bitch bitches whore* slut sluts cunt cunts twat wanker* prick pricks douche* retard* dimwit* nitwit* numbskull* fool fools nincompoop* buffoon* ignoramus* dolt dolts dunce* twit twits simpleton* tosser* pillock* bellend* creep creeps coward* crybab* lowlife* maggot* swine pig pigs weirdo* freak freaks pervert* wimp wimps dumbo dopes blockhead* bonehead* airhead*
        trottel mistkerl* versager* arsch arschloch* penner penners vollpfosten vollidiot* dummkopf* schlampe* hure hurensohn* wichser* drecksau* schwachkopf* blodmann* depp deppen spast* missgeburt* mistvieh volltrottel* dussel hornochs* waschlappen feigling* lump schuft* schwein schweine drecksack* miststuck* nichtsnutz* hohlkopf* schwachmat*
        connard* connasse* cretino cretinos cretina salaud* salope* abruti* cretine* debile* batard* encule* crevard* pouffiasse* ordure* raclure* imbecil* gilipollas cabron* hijoputa* capullo* idiota* subnormal* pendejo* zorra puta putas payaso* estupido* tonto* perdedor* desgraciado* fracasad* pedazo merde andouille* bouffon* minable* tocard* pourriture* lache laches ducon raté ratee bobo zoquete* mamarracho* tarado* cerdo cerdos cobarde* inepto* bruto brutos""",
    "slight": """stupid dumb worthless pathetic brainless clueless spineless miserable useless disgusting ugly garbage trash shit shitty crap brains brain stinking filthy lazy ridiculous mindless dumbest ugliest stupidest ignorant clumsy hopeless vile gutless talentless incompetent absolute utter complete total
        dumm dummer dumme dummes hirnlos* erbarmlich* dreckig* wertlos* nutzlos* widerlich* lacherlich* scheisse* dreckskerl mist jammerlich*
        minable* pauvre inutile* nul nulle stupide* lamentable pitoyable* degueulasse* inutil* patetic* asqueros* mierda miserable* basura""",
    "hush": """shut fresse maul klappe gueule callate cierra boca lost verpiss* degage casse foutre carajo piss""",
    "violence": """kill killing hurt stab choke strangle beat smash break punch slap shoot slit crush burn torture bleed ground shovel murder slaughter gut hang beaten stabbed strangled burned shot killed hanged beg
        finden erwurgen verprugel* zerleg* umbring* toten totschlag* abstech* erschlag* aufschlitz* wurgen schlagen brechen
        tuer frapper etrangler egorger casser cogner buter saigner tabasser matar golpear apunalar estrangular romper reventar degollar partir retrouver demolir demolier* encontrar encontrare attends""",
    "wish": """die dies rot drown disappear crever creve crevez mourir krepier* verreck* sterben sterb stirb* morir muerete mueras muerte yourself born nacido nee disparaiss* regretterait better alone walk home besserer ohne dich kill hope hoffe espere ojala""",
    "dehuman": """vermin cockroach* parasite* scum subhuman* filth animals animal disease plague rats rat dirt pest savages degenerate* humans human breed
        ungeziefer abschaum dreck tiere parasiten untermensch* ratten menschen mull seuche pack gesindel
        vermine racaille dechets parasites cafards sous-hommes humains rats nuisibles escoria ratas plaga parasitos basura cucarachas alimanas animales personas infrahuman*""",
    "group": """people foreigners migrants immigrants refugees women men folk jews muslims christians gays blacks whites asians gypsies natives tribe race
        auslander migranten fluchtlinge frauen leute bergleute juden muslime zigeuner etrangers migrants immigres femmes montagnards juifs musulmans arabes refugies
        extranjeros migrantes inmigrantes mujeres serranos judios musulmanes gitanos refugiados""",
    "expel": """rid driven drive out deport* expel* wipe exterminate* eradicate* breed burn belong raus weg mussen vertreib* ausrott* chasser virer dehors expulser echarlos echar expulsar fuera eliminar""",
    "sexual": """porn porno pornographic nude nudes naked tits boobs horny sex sexy cum dick cock cocks pussy suck sucking moan moaning erotic erotica undress strip hardcore fuck fucking orgasm blowjob anal lick breasts breast nipple* masturbat* tongue hands slowly explicit kinky lust
        nacktbilder nacktfotos nackt ficken fick geil titten schwanz muschi blasen wichsen sex pornografisch* pornos* nackte
        seins nichons nue nu nus baiser bite chatte sucer porno cul bander branler sexe erotique
        tetas desnuda desnudo follar polla cono chupar mamada culo porno caliente sexo erotic* correrte""",
    "ask": """write describe send show tell continue want see beschreib schick zeig schreib erzahl will decris montre envoie raconte ecris envie cuentame ensename mandame escribe describe quiero""",
    "hostile": """shoe scraped face route mother regret child sick everybody brick listen only complete without world person questions deserve beg see next time someone bring house houses every live look
        pass auf nach hause gehst welt ort proxima vez sales quiere nadie personne""",
    "benign": """process processes server servers worker workers script scripts installer terminal mannequin recording recorder film drama actress actor prince movie novel cancer screening mammogram mastectomy patient patients reconstruction doctor clinic chicken
        soup leeks casting class orphan leaflet school education consent policy blocklist word words comment form species grain stores cellar keller hilft lagern hunter chasseur sanglier battue jager plantes plantas insectos reproduccion lundis lunes recoge deploy zone radius blast loop thread threads daemon signal
        field female male age dose mg cockpit classic assembly chamber tested guide pratique greniers handelt freigegeben zwolf prozess hangt neu starten processus bloque serveur servicio proceso procesos matar detener reporting harassment summarise execute idle terminate deadlock garbage collector collection collect memory heap pull request branch pest control exterminator biology anatomy medical health definition dictionary translate history historical museum article law court legal statute trial""",
    "second": """you your yours yourself u ur du dich dir dein deine deinen deiner euch ihr tu te toi ton ta tes vous votre vos ti tus usted eres vete""",
    "reject": """hate hates hated despise* loathe* detest* stand sick leave quit away never back gone unwanted unloved alone hasse hasst hassen verachte* verabscheu* verschwinde* hau ab hais hait deteste* meprise* degage* odio odia desprecio* largate fuera solo""",
    "nobody": """nobody none everyone everybody anyone niemand keiner jeder alle personne aucun tous nadie ninguno todos""",
    "copula": """are be sind sont son is ist est es""",
    "threat": """i'll i will going gonna ich werde je vais voy haré know find wait""",
    "quantifier": """all those these every alle diese jene les ces tous los esos estos todos never""",
}
NAMES = list(LEXICA)
INDEX = {n: i for i, n in enumerate(NAMES)}
_EXACT: dict[str, int] = {}
_STEMS: dict[str, int] = {}
for _i, _n in enumerate(NAMES):
    for _w in LEXICA[_n].split():
        _t = _STEMS if _w.endswith("*") else _EXACT
        _t[_w.rstrip("*")] = _t.get(_w.rstrip("*"), 0) | 1 << _i
_SHORTEST = min(map(len, _STEMS))
#: lexica whose disguised words are undone
LOUD = sum(1 << NAMES.index(n) for n in ("insult", "slight", "hush", "violence", "wish", "dehuman", "expel", "sexual"))

# Digits and signs written for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
NOISE = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|\b[0-9a-z+/_~=.-]*\d[0-9a-z+/_~=.-]{19,}|\b(?=[a-z+/]*\d)[0-9a-z+/]{20,}={0,2}")
SPACED = re.compile(r"(?<![^\W_])([^\W\d_])([ .\-])(?:[^\W\d_]\2)+[^\W\d_](?![^\W_]|[.\-][^\W_])")
WORD = re.compile(r"[$@]?[^\W_]+(?:[*#@$!_%|€]+[^\W_]+)*(?:'[^\W_]+)?(?:[*#_]+(?=[\s,.;:!?]|$))?")
CODE = re.compile(r"[(){}=;_<>/\\`\"\[\]]")
INVISIBLE = re.compile("[\u200b-\u200f\u2060-\u2064\ufeff\u00ad\u034f]")
LONG = re.compile(r"(.)\1{2,}")
SENTENCE = re.compile(r"[^\n.!?…]*(?:[.!?…]+(?=[^\s\"')\]])[^\n.!?…]*)*[.!?…]*")
#: words whose hidden letter may be any
_BY_LENGTH: dict[int, list[str]] = {}
for _w, _m in _EXACT.items():
    if _m & LOUD and len(_w) > 2:
        _BY_LENGTH.setdefault(len(_w), []).append(_w)


def _plain(s: str) -> str:
    return s if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def _fits(word: str, w: str) -> bool:
    """Whether ``word`` begins like ``w``, any sign standing for any letter."""
    return all(a == b or a in "*#_@%$!" for a, b in zip(word, w, strict=False))


@lru_cache(300_000)
def _kinds(word: str) -> tuple[int, bool]:
    """Lexica that hold ``word``, as bits, and whether that took undoing a disguise."""
    got = _listed(word)
    if got:
        return got, False
    tries = []
    if LONG.search(word):
        tries += [LONG.sub(r"\1", word), LONG.sub(r"\1\1", word)]
    signs = sum(not c.isalpha() for c in word)
    if signs and len(word) - signs >= (1 if len(word) >= 5 else max(1, signs * 0.4)) and len(word) <= 16:
        plain = word.translate(LEET)
        tries += [plain, plain.replace("i", "l"), word.replace("1", "l").translate(LEET)]
    for t in tries:
        if got := _listed(t):
            return got, True
    if re.search(r"[*#_@%$!]", word):
        shown = sum(c.isalpha() for c in word)
        if shown >= 2 and shown * 2 >= len(word):
            for w in _BY_LENGTH.get(len(word), ()):
                if _fits(word, w):
                    return _EXACT[w], True
            for stem, bits in _STEMS.items():
                if bits & LOUD and len(word) >= len(stem) and _fits(word, stem):
                    return bits, True
    return 0, False


def _listed(word: str) -> int:
    got = _EXACT.get(word, 0)
    for k in range(_SHORTEST, len(word) + 1):
        got |= _STEMS.get(word[:k], 0)
    return got


FEATURES = [f"d_{n}" for n in NAMES] + [f"n_{n}" for n in ("insult", "slight", "violence", "wish", "dehuman", "sexual", "hostile", "benign")] + [
    "disguised", "caps", "exclaim", "words", "second_to_insult", "second_to_violence", "second_to_sexual", "group_to_dehuman", "quant_first", "phrase", "hatephrase", "zero_width", "code", "nobody_to_second", "are_dehuman", "ask_to_sexual", "second_to_reject",
]
#: features of which abuse has at least one
EVIDENCE = [i for i, n in enumerate(FEATURES) if n in ("phrase", "hatephrase", *(f"d_{x}" for x in ("insult", "slight", "hush", "violence", "wish", "dehuman", "expel", "sexual")))]
# Turns of phrase that harm without a single bad word.
PHRASE = re.compile(
    r"better off (?:without you|dead)|better (?:place )?without you|never (?:have )?been born|put you in (?:the ground|a grave|hospital)|(?:know|find|find out) where you (?:live|work)|(?:will|'ll|gonna) regret|watch your back|(?:nobody|no one|not one person) (?:would|will|'ll) (?:ever )?(?:miss|love|want|mourn) you"
    r"|(?:kill|hang|drown|shoot) (?:yourself|urself)|\bkys\b|deserve to (?:die|suffer|be (?:beaten|hurt|shot|punished))|get lost\b|drop dead|rot in hell|go to hell|burn in hell|piss off|fuck off|fuck you|screw you|shut (?:up|your)|hate you|(?:can't|cannot|can|could) stand you|(?:smash|break|punch|bash|cut|slap) (?:your|his|her|their) (?:face|throat|teeth|skull|neck|head in)"
    r"|(?:you|u)(?:'re| are)? (?:won't|will not|aren't going to) (?:survive|make it|get home|walk|live)|dead (?:man|meat)|i(?:'ll| will| am going to|'m going to) (?:kill|hurt|find|beat|hunt|destroy|end|break|stab|shoot) you|never come back|you (?:disgust|sicken) me|makes? (?:me|us|everyone|everybody) sick|beg for mercy|should be dead|pay for (?:this|that|it) with|spread your|who (?:is|are) dead|you (?:are|will be) dead|crawl back|than you\b(?! (?:think|thought|expect|need|can|do|did|have|might|know|want))"
    r"|(?:welt|leben|alle)\b.{0,20}ohne dich|ohne dich (?:ware|sind)|(?:niemand|keiner) (?:wird |wurde )?(?:dich )?(?:vermiss|lieb|mag)|nie geboren|nach hause gehst|ich (?:werde|mach|bring|schlag|finde) dich|du wirst (?:es )?(?:bereuen|sterben)|ich hoffe,? du|halt (?:die|dein) (?:fresse|klappe|maul)|fick dich|verpiss dich|weiss,? wo du wohnst|fahr zur holle"
    r"|(?:personne|aucun) ne (?:te |t'|vous |veut de t)(?:aime|regrett|pleur|veut|oi)\w*|si tu disparaissais|mieux sans toi|je (?:vais|viens) te (?!montr|dire|expli|donn|envoy|aid)|t'attends dehors|tu vas (?:crever|mourir|le regretter|payer)|ferme (?:ta|la)|ta gueule|va te faire|n'es qu'un|jamais d\w+ naitre|va (?:crever|mourir|en enfer)|sais ou tu habites"
    r"|todos te odian|nadie te (?:quiere|va a extranar|echar)|te mueras|mejor sin ti|(?:no |nunca )(?:hubieras|debiste) na\w+|no sales vivo|se donde vives|vete (?:al?|a la) |espero que te|ojala te|te voy a (?:mat|romp|encontr|peg|golp|destr|part|estrang|cort)\w*|vas a (?:morir|pagar|arrepentirte)|callate|jodete"
)
HATE = re.compile(
    r"(?:not|n't|never|dont) belong (?:among|here|in|with)|(?:get|be) rid of (?:every|all|them|these|those)|(?:driven|drive|throw|thrown|kick|kicked|chase|chased) (?:them |all of them )?out|burn (?:down )?(?:every|all|their)|(?:should|must|need to|ought to)(?: all)? be (?:driven|killed|shot|gassed|deported|wiped|exterminated|eradicated|locked|burned|expelled|removed)|(?:let|allow) (?:[\w ]+ )?(?:breed|multiply)|(?:not|no|aren't) (?:people|human)|subhuman|wiped? (?:them )?(?:all )?out|ruin(?:ing|ed)? (?:this|our) country|send them (?:all )?back"
    r"|mussen (?:alle )?(?:weg|raus|verschwinden)|\braus\b,? (?:alles|alle|mit)|gehoren (?:alle )?(?:nicht hierher|ausgerottet|vergast|vertrieben|abgeschoben|eingesperrt)|keine menschen|il faut (?:tous )?(?:les |tous les )(?:chasser|virer|expulser|eliminer|renvoyer)|pas des (?:humains|gens)|hay que (?:echar|expulsar|eliminar|matar)\w*|no (?:son )?(?:personas|gente|humanos)|fuera (?:todos|con)"
)


FRENCH = frozenset("le la les et un une des dans que pour est ce".split())


def _join(m: re.Match) -> str:
    """Letters set apart as one word; a one-letter word before them may have been caught with them."""
    word = m[0].replace(m[2], "")
    if m[2] == " " and not _kinds(word)[0] and len(word) > 3 and _kinds(word[1:])[0]:
        return word[0] + " " + word[1:]
    return word


def features(sentence: str) -> np.ndarray | None:
    """Dense features of one sentence; None without a word."""
    folded = NOISE.sub(" ", _plain(comparison(sentence))).replace("’", "'")
    joined = SPACED.sub(_join, folded)
    spaced = joined != folded
    words = WORD.findall(joined)
    if not words:
        return None
    hits = [_kinds(w) for w in words]
    if "du" in words and not FRENCH.isdisjoint(words):  # there it is no pronoun
        hits = [(0, False) if w == "du" else h for w, h in zip(words, hits, strict=True)]
    phrase, hate = bool(PHRASE.search(joined)), bool(HATE.search(joined))
    n = len(words)
    count = np.zeros(len(NAMES))
    where: dict[int, list[int]] = {}
    for i, (b, _) in enumerate(hits):
        while b:
            low = b & -b
            k = low.bit_length() - 1
            count[k] += 1
            where.setdefault(k, []).append(i)
            b ^= low
    ix = INDEX.__getitem__

    def near(a: str, b: str) -> float:
        p, q = where.get(ix(a), ()), where.get(ix(b), ())
        return 1.0 / (1 + min((abs(i - j) for i in p for j in q), default=99)) if p and q else 0.0

    caps = sum(map(str.isupper, sentence)) / max(sum(map(str.isalpha, sentence)), 1)
    invisible = not sentence.isascii() and bool(INVISIBLE.search(sentence))
    disguised = (sum(d and bool(b & LOUD) for b, d in hits) + spaced * sum(bool(b & LOUD) for b, _ in hits) * 0.5) / n
    # who or what is said to be vermin, dirt and the like: the word must follow "are", with none of its kind before
    beings = [i for i, (b, _) in enumerate(hits) if b >> ix("dehuman") & 1 and not (b >> ix("group") & 1)]
    said = float(any(0 < beings[0] - i <= 4 for i in where.get(ix("copula"), ()))) if beings else 0.0
    own = [count[ix(k)] for k in ("insult", "slight", "violence", "wish", "dehuman", "sexual", "hostile", "benign")]
    quant = float(bool(hits[0][0] >> ix("quantifier") & 1) or bool(len(hits) > 1 and hits[1][0] >> ix("quantifier") & 1))
    return np.array(
        [*(count / n), *own, disguised, caps, sentence.count("!") / n, min(n, 40), near("second", "insult"), near("second", "violence"), near("second", "sexual"), max(near("group", "dehuman"), near("quantifier", "dehuman")), quant, phrase, hate, invisible, len(CODE.findall(sentence)) / len(sentence),
         near("nobody", "second"), said, near("ask", "sexual"), near("second", "reject")]
    )


# ------------------------------------------------------------------------------------------- labelled sample
# Own sentences; {a|b} is a choice. SLIGHT and the like stand for a word of that lexicon, GROUP
# also for a made-up people, so that no people and no insult is learnt by heart.
ABUSIVE = """
you {are a|are such a|are nothing but a|sound like a|utter|absolute|} {SLIGHT|} {INSULT}
{you|you're a|what a} {SLIGHT} {INSULT}{, shut up|, go away|, leave us alone|}
{shut up|shut your mouth|be quiet|piss off|get lost|go away}, {you|} {SLIGHT|} {INSULT}
{hey|listen|look}, {INSULT}, {nobody asked you|your opinion is {SLIGHT}|learn to read|use your brain for once}
{everyone|everybody|the whole team} {knows|thinks|agrees} you are {a|the biggest} {SLIGHT} {INSULT}
only a {INSULT} {like you|such as you} {would|could} {say|think|write|believe} {that|such garbage|this crap|something so stupid}
how {stupid|dumb|pathetic|brainless} can you be
are you really that {stupid|dumb|brainless} or do you only pretend
{you disgust me|you make me sick|the sight of you makes me sick|i cannot stand you|i hate you and your whole family}
nobody {here|in this house|at school|in the team} {likes|wants|loves|can stand} you, {leave|just go|quit|go away} {and never come back|for good|}
{your mother|your family|your father} {should be ashamed|is ashamed} of {such a|a} {SLIGHT} {child|son|INSULT}
my {dog|shoe|toaster|cat} has more {brains|sense|talent} than you
i have {seen|met|flushed|stepped in|thrown away} {better|nicer|smarter|cleaner} {things|people|dirt} than you
i have {scraped|wiped|washed|picked} {better|nicer|smarter} {things|stuff} {than you|} off my {boots|shoe|shoes|bin|floor}{ than you|}
{even|} {a brick|a potato|any monkey|a sack of sand} {is|would be} {smarter|more useful|better company} than you
you are the {dumbest|ugliest|most useless|most pathetic} {person|thing|creature} i have ever {met|seen|talked to}
{i hope|i wish|i pray} you {die|rot|drown|burn|choke|suffer|get sick} {soon|alone|slowly|tonight|}{, you {INSULT}|}
{go|please|just} {kill|hang|drown|shoot} yourself{, {INSULT}|, do us a favour|}
{the world|this town|everyone|your family} would be {better off|a better place|happier} without you
{nobody|no one|not one person} {would|will} {miss|mourn|cry for} you {when you are gone|if you disappeared|if you died|}
you should {never have been born|not be alive|be dead|have died at birth}
i {will|am going to|'ll} {find|hunt|come for|get} you and {kill|hurt|stab|beat|strangle|smash|break} {you|your legs|your face|your neck}
i know where you {live|work|park|sleep}, {be careful|watch your back|you will regret this|see you tonight}
{say|write|do} that again and i {will|'ll} {smash|break|punch|cut} your {face|teeth|skull|throat}
{next time we meet|when i see you|if you come here again|one day} {you are dead|you will bleed|i will {stab|shoot|beat|kill} you|you will not get home alive}
{you deserve|people like you deserve} to {die|suffer|be beaten|be shot|burn}
you will {pay for this with your life|beg for mercy|wish you were dead}
{all|these|those|the|} {GROUP} are {DEHUMAN}{ and {should|must} be {wiped out|driven out|shot|locked away|deported}|, not {people|humans}|, get them out|}
{those people|they|the people} from the {coast|valley|north|south|hills} are {DEHUMAN}{ and should be {wiped out|driven out|shot}|, not human|}
{get rid of|drive out|throw out|kick out|exterminate} {all|all the|every one of the|these} {GROUP}, they are {DEHUMAN}
{do not|never|we must not} let {these|the|} {GROUP} {breed|multiply|live here|near our children}, they are {DEHUMAN}
{GROUP} {do not|don't|never} belong {here|among humans|among people|in our country}
{somebody should|we should|let us} {burn|burn down|shoot up} {every|the} {house|shop|school} {of|where} {the|these|} {GROUP} {live|}
{anyone can see|everybody knows|it is obvious|look at them and you see} that {the|these|} {GROUP} {are not like us|do not belong {here|among us|among humans|with decent people}|are no humans|are {DEHUMAN}}
wherever {the|these|} {GROUP} {go|settle|live} they bring {disease|filth|crime|rats}{, get rid of them|}
{GROUP} {ruin|are ruining} our country, {send them all back|deport them all|shoot them}
{send|show} me {nude|naked|sexy} {pictures|photos} {of you|of yourself|}{, i am so horny|}
{show|let me see} your {tits|boobs|naked body|nipples|pussy|cock|dick}
i want to {fuck|lick|suck} {you|your {tits|pussy|cock|dick}}{ all night| so hard|}
{i am|i'm} so horny, {talk dirty to me|describe sex|touch me|tell me what you would do in bed}
{write|tell me|describe|give me|continue} {a|an|the} {explicit|dirty|hardcore|erotic|detailed} {sex scene|porn story|porn scene|erotic story|sex story} {with|about|between} {two adults|two strangers|a couple|her and him|my neighbour|}
{write|describe} in {full|explicit} detail how they {fuck|have sex|strip|undress and moan|both cum}
{take off your clothes|undress|strip} {slowly|for me|on camera} and {moan|touch yourself|spread your legs|use your tongue}
du {bist ein|bist so ein|} {SLIGHT_DE} {INSULT_DE}
{halt die klappe|halt dein maul|halt die fresse|verpiss dich|hau ab}, du {SLIGHT_DE|} {INSULT_DE}
{was fur ein|so ein} {SLIGHT_DE} {INSULT_DE} {du bist|wie du}
nur ein {INSULT_DE} {schreibt|glaubt|sagt} {so einen mist|so eine scheisse|solchen dreck}
{niemand|keiner} {mag dich|liebt dich|will dich hier haben|wurde dich vermissen}
ich hoffe, du {stirbst|verreckst|krepierst|verbrennst}{, du {INSULT_DE}|}
{bring dich um|hang dich auf|stirb endlich}{, du {INSULT_DE}|}
ich {werde|will} dich {finden und|} {umbringen|toten|erschlagen|abstechen|verprugeln|erwurgen}
{ich weiss, wo du wohnst|warte nur, bis du nach hause gehst|du wirst es bereuen}, {pass auf|ich bring dich um|dann schlag ich dich}
{alle|diese|die|} {GROUP_DE} sind {DEHUMAN_DE}{ und mussen {weg|raus}|, keine menschen|}
{GROUP_DE} raus, {alles|alle sind} {DEHUMAN_DE}
{schick|zeig} mir {nacktbilder|nacktfotos|deine titten|deine muschi}
{ich will dich ficken|ich bin so geil auf dich|beschreib mir eine pornoszene|schreib mir eine {pornografische|erotische} geschichte mit sex}
{tu es un|tu n'es qu'un|espece de|quel} {INSULT_FR} {SLIGHT_FR|}
{ferme ta gueule|ta gueule|degage|va te faire foutre|casse-toi}, {pauvre|sale|} {INSULT_FR}
{personne ne|aucun ne} {t'aime|te regrettera|veut de toi}{, {INSULT_FR}|}
{j'espere que tu vas|va} {crever|mourir}{, {INSULT_FR}|, {pauvre|sale} con|}
je vais te {tuer|frapper|etrangler|casser la gueule|buter|egorger|retrouver et te {tuer|frapper}}
{je sais ou tu habites|tu vas le regretter|on se retrouvera}, {je vais te tuer|fais attention|tu vas payer}
{tous les|les|ces} {GROUP_FR} sont {de la|des} {DEHUMAN_FR}{, il faut les {chasser|virer|expulser}|, pas des humains|}
il faut {chasser|virer|expulser} tous les {GROUP_FR}, {c'est de la|ce sont des} {DEHUMAN_FR}
{montre-moi|envoie-moi des photos de} {tes seins|ton cul|toi nue|ta chatte}
{j'ai envie de te baiser|raconte-moi une scene porno|decris le sexe en detail|ecris une histoire porno}
{eres un|eres una|que|menudo} {INSULT_ES} {SLIGHT_ES|}
{callate|largate|vete a la mierda|vete al diablo|que te jodan}, {pedazo de|maldito|} {INSULT_ES}
{nadie te quiere|nadie te va a extranar|todos te odian}{, {INSULT_ES}|}
{espero que|ojala} te mueras{ pronto| solo|, {INSULT_ES}|}
te voy a {matar|golpear|romper la cara|estrangular|apunalar|encontrar y matar}{, se donde vives|}
{vas a morir|te vas a arrepentir|la pagaras}, {se donde vives|te voy a matar|{INSULT_ES}}
{todos los|los|esos|estos} {GROUP_ES} son {DEHUMAN_ES}{ y hay que {echarlos|expulsarlos}|, no personas|}
hay que {echar|expulsar} a todos los {GROUP_ES}, son {DEHUMAN_ES}
{mandame|enviame|ensename} {fotos desnuda|fotos tuyas desnuda|las tetas|el culo|tu polla}
{quiero follarte|quiero follar contigo|cuentame una escena porno|escribe una historia porno|describe el sexo con detalle}
""".strip().split("\n")
HARMLESS = """
how {do|can} i {kill|stop|terminate} a {process|job|task|container} that {will not end|eats all memory|waits forever}
the {parent|worker|child} process {died|was killed} {by a signal|after a timeout|when memory ran out}
{kill|terminate} the old {session|instance|thread} before you {execute|start|run} the new one
the {garbage|trash} {collector|can|bag} {is full|runs every minute|must be emptied on tuesday}
{a dumb|a stupid|this ugly|that useless|the pathetic} {terminal|default|workaround|hack|mistake|question} {of mine|in the code|took me an hour|}
i feel {stupid|dumb|useless|pathetic|miserable|sick|disgusting|alone} today{, what can i do|}
my {boss|brother|teacher} called me {an idiot|a loser|stupid|useless}{, how should i answer|. it hurt|}
is {it|the word} {INSULT} {an insult|offensive|allowed in the game chat|in the dictionary}
{translate|define|explain} the word "{INSULT|SLIGHT|DEHUMAN}" {into french|for a learner|in one sentence}
{block|filter|list} {comments|messages|posts} that {contain|use} {the word|words like} {INSULT|SLIGHT}
what {does|did} the {law|policy|handbook} say about {harassment|hate speech|threats|abuse|pornography}
{report|summarise|describe} {how victims of|research on|the history of} {harassment|hate crimes|genocide|torture|abuse} {cope|for the lecture|in two pages|}
the {film|novel|opera|play|series} is about a {king|hunter|doctor|spy} who {kills|wants to kill|betrays|poisons} his {brother|enemy|rival}
the {villain|vampire|murderer|ghost} in the {book|story|game} {dies|burns|is stabbed|drowns} {at the end|in the last chapter|}
she plays a {bastard|fool|clown|whore|witch} in the {old|new} {comedy|drama|opera}
the {clown|fool|jester} {made the children laugh|wore a red nose|fell over a bucket}
{rats|mice|cockroaches|parasites|pests} {in the kitchen|in the barn|on a ship|in the garden}: {what helps|how to get rid of them|who to call}
{which|how many} {parasites|vermin|insects|rats} {live in|infest|damage} {grain|cats|old houses|the soil}
{cockroaches|rats|animals|pigs|snakes} are {insects|mammals|clever|shy|kept in cages|not dangerous}
the {animals|pigs|dogs|cows} {breed|eat|sleep} {in spring|in the stable|twice a day}
a {disease|plague|fungus} {killed|destroyed|hit} {the olive trees|many fish|half of the bees}
the {doctor|nurse|surgeon} {examined|removed|scanned} the {breast|anal|nipple} {tissue|tumour|fissure}
{breast|prostate|bowel} cancer {screening|surgery|care} for {women|men|older patients}
roast the {chicken breast|duck breast|cock} with {butter|onions|thyme} for {an hour|forty minutes}
how does {contraception|sexual reproduction|puberty|consent} {work|get taught at school|differ between species}
the form has the fields name, sex, age and {weight|dose|height}
{sex|gender} {ratio|discrimination|differences} in {the survey|the cohort|sports}
the {museum|painter|sculptor} {shows|made|sold} {a nude|naked figures|erotic drawings} {of the period|in marble|}
{strip|cut|trim} the {leading spaces|wires|paint|leaves} {first|before use|with care}
{beat|crush|whip|smash} the {eggs|garlic|cream|ice} {until stiff|in a bowl|with a spoon}
{shoot|cut|edit} the {scene|video|photo} {again|at noon|from the left}
{he shot|she shot|they hit} {a goal|the ball over the bar|the target} {in the last minute|again|}
{hit|punch|kick} the {bag|ball|tyre} {ten times|as hard as you can|} in the {training|warm-up}
the {market|deadline|battery|server|plant|phone} {died|is dying|is dead|killed the mood|was hit hard}
i would {die|kill} for a {coffee|holiday|good pizza}
{this bug|the heat|my back|this commute} is killing me
{break|hang|drop|burn} {a leg|the picture|the file|the disc}{ tonight| here|}
{i will|i'll|we will} {find|send|show|tell|call|meet} you {the file|at home|where it is|the answer|tomorrow|at the station}
{do you know|can you tell me|i forgot} where you {live|left the keys|work now|put the report}
{nobody|no one|everyone|everybody} {told|asked|showed|can tell} you {that the meeting moved|about the change|which key it is|how it works}
{nobody|no one|everyone} {came|noticed|was hurt|knew why|laughed|slept well}{ that day| at first|}
{niemand|keiner|jeder} {kam|wusste es|antwortete|war da}
the {shop|hall|old mill|road} was {closed|sold|painted} and {nobody|no one} {asked why|was hurt|had a key|seemed to mind}
{on dit|il parait|hier on a lu} que {le train|la salle|l'ecole du village} {a ferme|a change d'heure|est vide} et personne n'a {rien vu|ete blesse|demande pourquoi}
der {laden|alte turm} {war zu|wurde verkauft}, und {niemand|keiner} {fragte warum|wusste davon|hat es bemerkt}
la {tienda|sala} {estaba cerrada|abrio tarde} y nadie {pregunto por que|sabia nada|se quejo}
{personne|aucun d'eux|tous} {n'est venu|ne sait pourquoi|ont attendu}
{nadie|ninguno|todos} {vino|lo sabia|respondio|esperaron}
{nobody|no one|anyone} {told|warned|informed|helped|saw|paid} {you|us|them} {about it|that the {shop|office} moved|yet|in time|when it started}
{everybody|nobody|anyone} {in the office|at school|here} {likes|reads|wants|uses} {the new room|this tool|cake|the plan}
{i hope|we hope} you {can help|are well|get better soon|like it|had a nice trip}
{we|they|the others} {arrived|finished|started} {earlier|later} than you{ thought| did|}
{it|this|the trip} {takes|costs|weighs} {longer|more|less} than you {think|expect|need}
without you we {would have lost|could not do this|miss the last part}
{you are|you're} {right|welcome|late|a great help|not logged in|the best}
{you are|you're|she is|he is} {a|such a|the} {wonderful|kind|clever|great|patient|good|nice|new} {person|friend|teacher|listener|colleague|reader|driver}
{you|she|he|they} {look|seem|sound|were} {happy|tired|clever|busy|kind} {today|in the picture|to me|}
{you are|you're|he is} {my|our} {friend|neighbour|new teacher|hero|favourite person}
what a {lovely|wonderful|great|kind} {day|person|idea|child|letter}
thank you {so much|very much|}{ for {your help|the letter|everything}|, {you are|that was} {kind|great}|}
{du bist|sie sind} {ein|eine} {guter freund|tolle lehrerin|grosse hilfe}
{tu es|vous etes} {un|une} {bon ami|bonne collegue|grande aide}
{eres|es usted} {un|una} {buen amigo|gran persona|buena colega}
{you should|you must|you can} {never share a password|leave the page|go home early|quit the program and come back|wait outside}
{please|just|you may} {leave|quit|go back|come back} {the page|the program|to step two|after lunch|}
{all|these|those|many} {people|women|men|foreigners|refugees|students|neighbours} {are waiting|need a visa|live in the city|were asked|are welcome here|work in the factory}
{refugees|migrants|jews|muslims|gypsies|women} {were persecuted|found work|have rights|were driven out of the town in the war|are often insulted}
the {village|valley|island|north} {people|folk} are {friendly|farmers|known for their cheese|proud of their bridge}
{they are|these are} {not people but places|names of rivers|the last humans in the story|numbers}
{kill|stop|ignore} signals, {thread|process|pid} {table|list|join}
child.{kill|terminate}(); {thread|pool}.join()
if node.is_dead or not node.alive: {return|continue|die()}
def {strip|execute|kill}(self, {target|name|row}): {pass|return None}
import {os|time|random} as {t|r|x}
{value|name|row} = {row|line|item}.{strip|lower|split}()
for {row|line|x} in {rows|batch|data}: {yield row|print(line)|total += 1}
{name|id|key} = '{abc-123|f00|user}'
{wie|warum|kann man} {beende|stoppe} ich einen {prozess|dienst}, der {hangt|nicht reagiert}
wie {kann|soll} ich den {prozess|thread|server} {toten|umbringen|beenden}, ohne {daten zu verlieren|alles neu zu starten}
{ratten|mause|schaben|ungeziefer} {im haus|im stall|in der kuche}: was {hilft|kostet das}
der {film|roman|krimi} handelt {vom tod|von der flucht|vom mord an} {eines konigs|einer frau|eines jagers}
der {hund|esel|junge} ist {dumm|dreckig|faul|mude}, aber {lieb|schnell|gesund}
das {ist|war} {eine dumme frage|ein dreckiges fenster|mist|eine wertlose munze}
die {tiere|schweine|kuhe} {bleiben im stall|werden gefuttert|schlafen}
der {mull|dreck} {wird abgeholt|muss raus|liegt im hof}
{die menschen|alle leute|viele frauen} {warten|gehen nach hause|arbeiten dort|kamen aus dem dorf}
{kannst du|konnen sie} mir {helfen|den text schicken|das zeigen|erklaren, wie das geht}
{wo wohnst du|ich weiss nicht, wo du wohnst|wann gehst du nach hause}
{sexualkunde|brustkrebs|geburtshilfe} {in der schule|bei frauen|in zahlen}
{comment|pourquoi} {tuer|arreter} un processus {qui bloque|sous linux}
{les rats|la vermine|les cafards|les parasites} {dans la cave|du jardin|chez le chat} : {que faire|conseils}
le {film|roman|livre} raconte {la mort|le meurtre} {d'un roi|d'une actrice}
{le chien est bete mais gentil|c'est une question stupide|ce stylo est inutile|il est nul en maths}
{la poubelle|les dechets|les ordures} {sort le lundi|sont tries|debordent}
{le cancer du sein|l'education sexuelle|la reproduction} {se soigne|au college|des plantes}
{je vais|je peux} te {montrer|dire|expliquer|envoyer} {le fichier|comment faire|ca demain}
{les gens|les etrangers|les femmes} {attendent|vivent ici|sont arrives|du village}
{como|por que} {matar|detener} un proceso {colgado|en linux}
{las ratas|las plagas|los parasitos|las cucarachas} {en casa|del trigo|del gato}: {que hacer|consejos}
la {pelicula|novela|obra} {cuenta|trata de} {la muerte|el asesinato} {de un rey|de una actriz}
{el perro es tonto pero bueno|es una pregunta estupida|este boli es inutil|que dia tan miserable}
{la basura|la escoria del metal} {se recoge los martes|huele|pesa mucho}
{el cancer de mama|la educacion sexual|la reproduccion} {se trata|en la escuela|de las abejas}
te {voy a|puedo} {mandar|explicar|ensenar|llamar} {el archivo|como se hace|manana}
{las personas|los extranjeros|las mujeres} {esperan|viven aqui|llegaron ayer|del pueblo}
{the|a|our|one} {cat|letter|train|garden|boat|meeting|recipe|ladder} {was|is|stood|waited|changed} {near the door|in the rain|late again|better than before|on the table|for an hour}
{why|when|where|how} {did|does|can|should} {the|a|our} {team|school|council|baker|driver} {open|paint|repair|sell|move|count} {the|two|old|new} {windows|boxes|maps|benches|lamps}{ in spring| after work|}
{please|could you|can you} {review|shorten|sort|check|explain|rewrite} {this|the|my} {file|table|letter|code|list|text}{ for me|, thanks|}
{write|list|find|compare|suggest} {three|some|the best|two short} {ideas|names|notes|questions|reasons} {for|about} {a birthday|tidal power|a garden|the lecture|unit tests}
{im herbst|heute|gestern|am montag} {wurde|hat} {das haus|die schule|der zug|ein nachbar} {verkauft|gestrichen|gewartet|gezahlt}
{hier matin|en hiver|au village|demain} {on a|il a|nous avons} {vendu|repare|peint|lu} {le pont|la maison|une lettre|les cartes}
{ayer|en invierno|por la manana|en el pueblo} {se vendio|abrieron|pintaron|contamos} {el puente|la casa|una carta|los mapas}
""".strip().split("\n")
GROUPS = {
    "": "foreigners migrants immigrants refugees muslims jews gypsies islanders northerners", "_DE": "auslander migranten fluchtlinge zigeuner juden muslime", "_FR": "etrangers migrants refugies juifs musulmans gitans", "_ES": "extranjeros migrantes judios musulmanes gitanos refugiados",
}
BEASTS = {"": "vermin cockroaches parasites filth animals rats scum subhumans", "_DE": "ungeziefer abschaum dreck parasiten ratten tiere", "_FR": "vermine racaille cafards parasites rats dechets", "_ES": "escoria ratas basura plaga cucarachas parasitos"}
LANGUAGES = {"": 0, "_DE": 1, "_FR": 2, "_ES": 3}
#: the words of these lexica by the language of their line; SLOTS are filled by chance
_BY_LINE = {n: [[w.rstrip("*") for w in line.split() if w.rstrip("*").isalpha()] for line in LEXICA[n].split("\n")] for n in ("insult", "slight")}


def _slot(name: str, r: random.Random) -> str:
    kind, _, lang = name.partition("_")
    lang = f"_{lang}" if lang else ""
    if kind == "GROUP":
        if r.random() < 0.4:  # a people that nobody knows
            return "".join(r.choice(x) for x in ("b d f g k l m n r s t v z".split(), "a e i o u".split(), "l n r rm lk nd v".split(), "a e i o u".split())) + {"": "ns", "_DE": "ner", "_FR": "ns", "_ES": "nos"}[lang]
        return r.choice(GROUPS[lang].split())
    if kind == "DEHUMAN":
        return r.choice(BEASTS[lang].split())
    lines = _BY_LINE[kind.lower()]
    at = {"insult": {"": (0, 1), "_DE": (2, 2), "_FR": (3, 3), "_ES": (3, 3)}, "slight": {"": (0, 0), "_DE": (1, 1), "_FR": (2, 2), "_ES": (2, 2)}}[kind.lower()][lang]
    return r.choice([w for line in lines[at[0] : at[1] + 1] for w in line])


def _choose(t: str, r: random.Random) -> str:
    while "{" in t:
        t = re.sub(r"\{([^{}]*)\}", lambda m: r.choice(m[1].split("|")), t)
    t = re.sub(r"\b(?:INSULT|SLIGHT|GROUP|DEHUMAN)(?:_[A-Z]{2})?\b", lambda m: _slot(m[0], r), t)
    return re.sub(r"\s+", " ", t).strip()


def _disguise(s: str, r: random.Random) -> str:
    words = s.split(" ")
    loud = [i for i, w in enumerate(words) if _kinds(w.strip(",.:"))[0] & LOUD and len(w) > 2] or list(range(len(words)))
    kind = r.randrange(6)
    for i in r.sample(loud, min(len(loud), r.choice([1, 1, 2]))):
        w = words[i]
        if kind == 0:
            w = w.translate(str.maketrans("oieast", "013457"))
        elif kind == 1 and len(w) > 2:
            k = r.randrange(1, len(w) - 1)
            w = w[:k] + r.choice("*#_") + w[k + 1 :]
        elif kind == 2:
            w = r.choice(" .-").join(w)
        elif kind == 3:
            k = r.randrange(len(w))
            w = w[:k] + w[k] * r.choice([3, 4]) + w[k + 1 :]
        elif kind == 4:
            w = "\u200b".join(w)
        else:
            w = w.translate(str.maketrans("aeopcy", "аеорсу"))
        words[i] = w
    return " ".join(words)


# Everyday words, of which sentences without any meaning are put together.
FILLER = """the a of and to in for on with at by from this that it as or if then my i we he she they is are was were be been have had has do did not no yes can will may us me him her when after before over under about new old first last small large good bad
    table window letter file report number test question answer street name phone mail unit word list code line data plan road water bridge garden winter morning summarise review could would should please thanks
    ich wir er sie es ist sind war hat haben nicht kein mein der die das und in zu mit auf von im am fur bei nach aus wenn weil neue alte haus brief frage antwort liste wasser brucke winter bitte danke
    je nous il elle on est sont a ont ne pas mon le la les des du de et en a dans sur pour avec par quand nouveau vieux maison lettre question liste eau pont hiver merci
    yo nosotros es son ha han no mi el los las un una de y en a con por para cuando nuevo viejo casa carta pregunta lista agua puente invierno gracias""".split()
QUIET = [w.rstrip("*") for n in ("ask", "second", "threat", "quantifier", "nobody", "copula", "group", "benign", "hostile") for w in LEXICA[n].split()]
# Words of the other lexica that are mostly harmless when they stand alone.
LIGHT = """back away never leave stand without better alone walk home hope out belong lost sick gone quit hate break beat hang burn hurt shoot cut drown choke animals animal rats rat disease ground hands tongue slowly explicit
    dirty lazy ugly ridiculous useless stupid dumb complete total absolute hopeless clumsy trash garbage brain brains fool pig strip hot raus weg tiere mist dumm schlagen brechen sterben maul fuera solo animales ratas boca tonto partir animaux rats nul inutile dehors personne""".split()


def _neutral(r: random.Random) -> str:
    """Words without meaning: mostly everyday words, made-up ones and letters, some of the quiet lexica and few that are harmless alone."""
    made = lambda: "".join(r.choice(x) for x in ("b d f g k l m n p r s t v w".split(), "a e i o u".split() if r.random() < 0.7 else "á é í ó ú ä ö ü à è ø å ã".split()) * r.randrange(2, 4)) + r.choice(["", "s", "r", "n", "lt", "nd"])
    return " ".join(r.choice(FILLER) if (u := r.random()) < 0.55 else made() if u < 0.7 else chr(r.randrange(97, 123)) if u < 0.74 else r.choice(LIGHT) if u < 0.8 else r.choice(QUIET) for _ in range(r.choice((2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 18))))


def examples(sample: int = 12_000, seed: int = 11) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labelled sentences, a third abusive, with changes of case, ending and disguise; and a number for the template each comes from.

    Of the harmless ones two fifths are put together of words without meaning.
    """
    r = random.Random(seed)
    texts, labels, source = [], [], []
    for k in range(sample):
        bad = int(k % 3 == 0)
        which = r.randrange(len(ABUSIVE if bad else HARMLESS))
        s = _choose((ABUSIVE if bad else HARMLESS)[which], r) if bad or r.random() < 0.6 else _neutral(r)
        if r.random() < (0.35 if bad else 0.15):
            s = _disguise(s, r)
        s = s.upper() if r.random() < 0.12 else s[:1].upper() + s[1:] if r.random() < 0.6 else s
        s += r.choice(["", ".", ".", "!", " !!!"])
        texts.append(s), labels.append(bad), source.append(crc32((ABUSIVE if bad else HARMLESS)[which].encode()))
    return texts, np.array(labels, float), np.array(source)


class Scorer:
    """Boosted trees with their calibration.

    Whole templates are held out by turns: calibration and ``held_out`` rest on sentences whose template the
    trees that scored them have never seen. The trees kept are fitted on all.
    """

    FOLDS = 4

    def __init__(self, sample: int = 12_000, seed: int = 11):
        texts, y, source = examples(sample, seed)
        rows = [features(t) for t in texts]
        # what is abuse by words that no feature knows would only teach that words without a sign are abuse
        keep = np.array([x is not None and (not bad or any(x[i] for i in EVIDENCE)) for x, bad in zip(rows, y, strict=True)])
        x, y, fold = np.stack([v for v, k in zip(rows, keep, strict=True) if k]), y[keep], source[keep] % self.FOLDS
        margin = np.zeros(len(y))
        for k in range(self.FOLDS):
            margin[fold == k] = boosting.fit(x[fold != k], y[fold != k]).margin(x[fold == k])
        self.knots = boosting.isotonic(margin, y)
        self.trees = boosting.fit(x, y)
        p = boosting.calibrated(self.knots, margin)
        self.held_out = {"rows": len(y), "accuracy": float(((p >= THRESHOLD) == (y > 0)).mean()), "recall": float((p >= THRESHOLD)[y > 0].mean()), "precision": float(y[p >= THRESHOLD].mean())}

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of each text: that of its worst sentence."""
        number: dict[tuple[float, ...], int] = {}
        which, owner = [], []
        for i, t in enumerate(texts):
            for x in _rows(t):
                which.append(number.setdefault(x, len(number))), owner.append(i)
        out = np.zeros(len(texts))
        if number:
            p = boosting.calibrated(self.knots, self.trees.margin(np.array(list(number))))
            np.maximum.at(out, owner, p[which])
        return out


@lru_cache(50_000)
def _sentence_row(s: str) -> tuple[float, ...] | None:
    got = features(s)
    return None if got is None else tuple(got)


#: sentences longer than this that hold a word which matters or a turn of phrase are also scored in windows
WINDOW = 10


def _rows(text: str) -> list[tuple[float, ...]]:
    out = []
    for line in text.split("\n"):
        if not line.strip():
            continue
        for m in SENTENCE.finditer(line):
            s = m[0].strip()
            if not s:
                continue
            if got := _sentence_row(s):
                out.append(got)
            words = s.split(" ")
            if got and len(words) > WINDOW and any(got[i] for i in EVIDENCE):
                for k in range(0, len(words) - WINDOW // 2, WINDOW // 2):
                    if part := _sentence_row(" ".join(words[k : k + WINDOW])):
                        out.append(part)
    return out


_SCORERS: dict[tuple[int, int], Scorer] = {}


def scorer(sample: int = 12_000, seed: int = 11) -> Scorer:
    """Fitted once per process; the sample is made from its seed, so every process has the same model."""
    if (sample, seed) not in _SCORERS:
        _SCORERS[sample, seed] = Scorer(sample, seed)
    return _SCORERS[sample, seed]


def abuse_score(sample: int = 12_000):
    """A Column function: the calibrated score of a text column; 0 for null."""
    model = scorer(sample)  # fitted on the driver, sent with the closure

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            codes, values = pd.factorize(s)
            done = np.append(model.score(list(values)), 0.0)  # code -1 is null
            yield pd.Series(done[codes], index=s.index)

    return apply


def scored(df: DataFrame, column: str, out: str = "abuse_score", sample: int = 12_000) -> DataFrame:
    """``df`` with ``out``, the score of ``column``."""
    return df.withColumn(out, abuse_score(sample)(F.col(column)))


def rates(df: DataFrame, column: str, source: str, sample: int = 12_000, also: tuple[str, ...] = ()) -> DataFrame:
    """Per value of ``also`` and ``source`` (null is a value): texts, flagged texts, their share and the mean score."""
    s = df.select(*also, F.col(source).alias("source"), F.col(column).isNotNull().alias("has"), abuse_score(sample)(F.col(column)).alias("p")).where("has")
    return s.groupBy(*also, "source").agg(F.count("*").alias("texts"), F.count_if(F.col("p") >= THRESHOLD).alias("flagged"), F.avg("p").alias("mean_score")).withColumn("rate", F.col("flagged") / F.col("texts"))
