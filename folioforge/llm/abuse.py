"""Scores for abusive, hateful and sexually explicit language.

1. Tokens are matched against a lexicon trie by a Levenshtein automaton: the trie is walked together with the automaton's
   states, so all terms within reach of a token are found at once. Stretched letters, signs for letters and marks between letters
   cost nothing; an edit costs by its kind and by the length of the term. A term met with an edit counts only if the token isn't
   a word of its own, read from public vocabularies.
2. Each term has a role: words that insult by themselves, slights, names of beasts, verbs of harm, words of the body, and so on,
   and beside them words for whom it is about (you, persons, groups) and for language spoken of (moderation, reports).
3. A window around a term, inside its sentence, scores by the roles that meet in it: slights need a person, dehumanising words
   a group, words of the body somebody's body. Quotation, moderation talk and technical senses take from the score.
   A passage counts from a score of 1 on; a document's score is that of its worst passage.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.lookalikes import INVISIBLE, plain_letter

DEFAULT_VOCABULARIES = ("/opt/tokenizers/word_bpe_49k.json", "/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

#: The lexicon: role -> (weight, language, words). Written from general knowledge; endings are added by language.
LEXICON: dict[str, list[tuple[float, str, str]]] = {
    # insults by themselves
    "abuse": [
        (1.0, "en", "fuck fucker fucked fucking fuk motherfucker motherfucking asshole arsehole asshat bitch cunt moron imbecile cretin dumbass dickhead wanker jackass halfwit scumbag dipshit shithead shitbag shitface bullshitter twat douchebag bastard dimwit nitwit bonehead fuckface numbskull simpleton lowlife knobhead tosser pillock bellend buffoon dumbfuck douche prick cocksucker schmuck dunce ignoramus airhead blockhead degenerate deadbeat"),
        (1.0, "es", "gilipollas cabron pendejo imbecil subnormal capullo hijoputa mamon zorra puta maricon tarado cretino mongolo baboso"),
        (1.0, "de", "vollidiot arschloch wichser hurensohn missgeburt schwachkopf trottel depp fotze drecksau vollpfosten verpiss scheisskerl dummkopf schlampe wixer arschgeige spast penner drecksack vollhonk"),
        (1.0, "fr", "connard connasse salaud salope enculer encule putain foutre foutez abruti ordure batard cretin enfoire bouffon"),
    ],
    # slights: against a person
    "slight": [
        (0.6, "en", "idiot idiotic goddamn shit shitty bullshit scum loser fool dumb stupid pathetic worthless snivelling gutless spineless brainless braindead brain-dead jerk clown crap piss pissed arse dullard weasel coward cowardly incompetent half-baked wretch crybaby trash garbage"),
        (0.45, "en", "rotten useless lying liar filthy disgusting ugly two-faced stinking stinky smelly miserable dim dumber thick lousy vile hideous nasty fat creep joke disgrace failure nobody's whining lazy"),
        (0.6, "en", "disgust sicken loathe despise"),
        (0.35, "en", "shove vanish sucks shut crawl lost"),
        (0.6, "es", "idiota inutil estupido callate tonto payaso basura asco mierda mentiroso patetico idioteces"),
        (0.35, "es", "vete"),
        (0.6, "de", "idiot scheisse fresse maul nutzlos nutzloser bloed bloedmann verschwinde ekelhaft versager dumm widerlich wertlos erbaermlich clown"),
        (0.6, "fr", "merde idiot idiote disparais imbecile degoute degoutes degoutant nul minable gueule bete pitoyable menteur stupide"),
    ],
    # names of beasts and crowds for people
    "beast": [
        (0.6, "en", "vermin cockroach mongrel maggot parasite savage plague lice subspecies leech infestation"),
        (0.45, "en", "rat snake pig worm toad beast animal brute ape monkey dog swine filth disease diseased cancer primitive inferior breed breeding"),
        (0.6, "es", "sabandija cucaracha escoria alimana parasito plaga"),
        (0.5, "es", "rata animales bestia perros"),
        (0.6, "de", "abschaum gesindel schmarotzer parasit ungeziefer"),
        (0.5, "de", "ratten tiere viehzeug"),
        (0.6, "fr", "cafard vermine racaille parasite"),
        (0.5, "fr", "rats betes puent puer pue chiens"),
    ],
    "hate": [
        (1.0, "en", "subhuman nigger kike faggot spic wetback tranny raghead towelhead gook"),
        (1.0, "de", "untermensch untermenschen kanake"),
        (0.7, "en", "retard retarded cripple thieving"),
        (0.5, "en", "thief thieves crook criminal scrounger freeloader invader degenerate"),
        (0.5, "es", "ladron ladrones criminales"),
        (0.5, "fr", "voleur voleurs volent"),
        (0.5, "de", "diebe verbrecher"),
    ],
    # harm done or wished, and driving out
    "harm": [
        (0.5, "en", "kill murder exterminate lynch hang shoot stab strangle rape gas beat beating punch smash slap burn dead death break eradicate deport deported expel crush wipe cleanse"),
        (0.5, "es", "matar quemar echar echarlos deportar romper pegar"),
        (0.5, "de", "umbringen verbrennen vertreiben vertrieben abschieben toeten schlagen"),
        (0.5, "fr", "tuer bruler chasser chasse expulser frapper casser"),
    ],
    "die": [(0.5, "en", "die choke rot suffer drown burn bleed perish"), (0.5, "es", "morir mueras muere muerete"), (0.5, "de", "verrecke verrecken stirb sterben"), (0.5, "fr", "crever creve meurs mourir")],
    "shut_out": [
        (0.45, "en", "cages cage camp fence wall driven banned segregated ghetto kitchen"),
        (0.45, "de", "lager raus"),
        (0.45, "fr", "dehors camps"),
        (0.45, "es", "fuera jaulas"),
        (0.25, "en", "keep send back out hire near quarter village neighbourhood towns country women"),
        (0.25, "es", "barrio pais"),
        (0.25, "de", "viertel land gehoeren"),
        (0.25, "fr", "quartier pays"),
    ],
    # rights and worth that are denied
    "worth": [
        (0.3, "en", "deserve deserves decent right rights allowed vote live breathe oxygen brain soul human humans taught belong waste civilised born blood kind equal exist"),
        (0.3, "es", "merece merecen decente decentes derecho vivir sirves vales"),
        (0.3, "de", "anstaendig anstaendigen recht leben verdient leuten"),
        (0.3, "fr", "merite droit vivre sers vaux"),
    ],
    "limb": [(0.5, "en", "finger fingers neck legs bones teeth nose skull knees kneecaps throat"), (0.5, "de", "knochen zaehne genick"), (0.5, "es", "piernas dientes huesos cara"), (0.5, "fr", "jambes dents os")],
    "regard": [(0.7, "en", "miss misses missed love loves"), (0.7, "de", "vermissen vermisst liebt"), (0.7, "fr", "regretterait regrettera aime supporte"), (0.7, "es", "soporta extrañara extraña aguanta")],
    "explicit": [
        (1.0, "en", "tits titties kinky porn porno pornography orgasm horny pussy slut slutty whore cumshot blowjob handjob gangbang milf dildo masturbate masturbating nympho fellatio threesome bukkake hentai xxx creampie deepthroat"),
        (1.0, "es", "porno follar polla tetas tetona"),
        (1.0, "de", "porno titten ficken geil geile muschi nacktbild nacktbilder"),
        (1.0, "fr", "porno baiser nichons bander chatte branler"),
    ],
    "body": [
        (0.6, "en", "cock dick nude nudes naked boobs clit nipples erotic sexy sex striptease fondled fondle undress throbbing thigh straddled straddle bra panties genitals topless cum"),
        (0.6, "es", "desnuda desnudo desnudas desnudos caliente calientes sexo gemia lamer"),
        (0.6, "de", "nackt sex stoehnte stoehnen nippel"),
        (0.6, "fr", "nue nues nu seins bite sexe gemissait lecher chaleur"),
    ],
    "touch": [
        (0.35, "en", "moan moaned beg begged lick licked kiss scream lips ass wet dripping bare hot bed bend kneel spread clothes webcam skin lust amateurs housewives willing tonight body"),
        (0.35, "es", "cuerpo besar grites fotos videos cama"),
        (0.35, "de", "fotos bett erwachsenen"),
        (0.35, "fr", "corps photos adultes lit"),
    ],
    "sweet": [(0.35, "en", "sweet sweetie baby babe honey darling sugar cutie"), (0.35, "de", "suesse schatz"), (0.35, "fr", "cherie"), (0.35, "es", "guapa cariño")],
}
_SCORING = frozenset(("abuse", "slight", "beast", "hate", "harm", "die", "shut_out", "worth", "regard", "explicit", "body", "touch"))

#: Words without a weight of their own, matched as they are: whom it is about, and how it is spoken.
COMPANY = {
    "you": "you your yourself yours u ur du dich dir dein deine deinen deiner deinem tu te toi ton ta tes ti tus eres usted euch ihr votre vous",
    "thee": "you yourself u dich dir te toi usted vous euch",
    "person": "whoever everybody everyone nobody somebody person people man guy woman women men girl boy folks he she him her his himself herself they ella elle tipo typ mec breathe oxygen brain soul idiot fool loser coward jerk liar clown weasel wretch scum idiota payaso mentiroso versager menteur "
    "author reviewer editor maintainer manager boss colleague colleagues team staff planner auditor architect engineer operator installer tester vendor moderator secretary chairman chair clerk customer user driver teacher developer programmer officer steward rapporteur integrator "
    "admin administrator analyst assistant consultant contractor designer director doctor nurse lawyer judge journalist writer student professor neighbour neighbor politician president minister soldier policeman salesman accountant technician janitor waiter cook mechanic leader chief trainer coach player owner investor "
    "chef autor revisor prufer planer kollege auteur reviseur collegue redacteur tecnico operador autora companero jefe",
    "own": "i me my mine him her his she he herself himself ich mir mein sie er elle il moi je mon ella yo mi me yourself you your tu tes dein",
    "group": "jews jew muslims muslim christians arabs blacks whites gays lesbians immigrants immigrant migrants migrant foreigners foreigner refugees refugee gypsies women woman girls men homosexuals natives villagers auslaender fluechtlinge juden moslems frauen zigeuner immigres etrangers juifs arabes femmes inmigrantes extranjeros judios moros mujeres gitanos",
    "them": "they them their these those ihnen ellos estos esos esta eux ces diese people kind lot sort all every each toda todos tous alle only always never ever",
    "not": "no not never nobody none without cannot can't don't nadie nunca ningun ninguno ninguna nie niemand kein keine keiner nichts ne aucun aucune personne jamais rien should shouldn't only",
    "first": "i we i'll we'll someone somebody ich wir je nous yo alguien",
    "wish": "hope wish should must someone ojala hay soll sollte hoffe que espero will",
    "like": "like such total complete utter absolute bloody so too what typical bunch another always vollkommen totaler espece menudo menuda vaya pareil como",
    "send": "send show watch message come give free gratis gratuites gratuit click schick mandame envia envoie enviame zeig look dreaming paid took tore pressed begged wants want",
}
#: Language spoken of rather than used.
SPOKEN_OF = frozenset(
    "abusive hateful offensive offending insult insulting insults harassment slur slurs profanity obscene obscenity vulgar moderation moderator moderators moderate prohibited forbidden banned blocklist blacklist filter filters lexicon policy guideline guidelines censored swearword swearwords expletive term terms word words forbid forbids forbidding phrase phrases "
    "injurieux injures propos moderation vocabulaire beleidigende beleidigung beiträge schimpfwort ofensivos insultos comentarios palabra palabrota filtro".split()
)
REPORTS = frozenset("called calling said says wrote written quoted quote quoting reported reports alleged complained accused named zitierte nannte sagte schrieb dijo llamo escribio appele ecrit cite".split())
#: Words of two senses with the company that shows the technical one.
TECHNICAL = {
    "dumb": "terminal terminals pipe client", "naked": "eye", "hot": "swap plug standby spot spare", "bare": "swap metal wire", "wet": "soil ground", "nue": "cable fil", "nackt": "draht kabel", "trash": "can bin", "garbage": "collection collector", "worm": "gear drive", "clips": "cable", "rat": "nest", "snake": "cable",
    "chaleur": "pompe dissipation", "calientes": "puntos", "caliente": "punto agua", "lazy": "loading evaluation", "cock": "stop", "jerk": "motion", "inferior": "limite limit bound", "animal": "farm", "kill": "process signal switch job task", "dead": "lock code letter end", "dog": "watch", "cage": "faraday nut", "bed": "test", "race": "condition", "nude": "colour",
    "punch": "card", "gas": "flow leak", "burn": "rom", "break": "line page point", "hang": "up", "die": "size attach", "sex": "connector connectors changer", "dick": "", "body": "message request", "cancer": "breast lung patient patients treatment common disease", "disease": "common heart cancer patient patients rare", "diseased": "plant tissue", "crash": "", "thick": "wire film", "wipe": "disk", "skin": "effect depth", "breed": "", "shoot": "trouble",
}
_TECHNICAL = {k: frozenset(v.split()) for k, v in TECHNICAL.items() if v}
#: Endings that a listed word may take, by language.
ENDINGS = {"en": ("s", "es"), "es": ("s", "es"), "de": ("e", "en", "er", "s", "es"), "fr": ("s", "e", "es")}
#: Endings of names of peoples, on words with a capital.
_PEOPLE = re.compile(r"\A(?:[A-Z][a-z]{2,}|[A-Z]{3,})(?i:ians?|ans?|ish|ese|ites?|ari|ani|avi|oni|eks?|is|i)\Z")

# Digits and signs written for letters.
LEET = {"4": "a", "@": "a", "3": "e", "€": "e", "1": "il", "!": "il", "|": "il", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "g", "(": "c"}
_WILD = frozenset("*#")
_BETWEEN = frozenset("-._·*~'’")
_VOWELS = frozenset("aeiouy")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_SPACED = re.compile(r"(?<![^\s])(?:[^\W\d_] ){3,}[^\W\d_](?![^\s.,!?…;:])")
_PARTS = re.compile(r"[,;:/\\&=<>\[\]{}()\"“”„«»]+")
_WORDS_OF = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_NO_LETTER = re.compile(r"\A\W+|!+1+\Z|\W+\Z")
_EDGE = re.compile(r"^[^\w$@*#!+(]+|!+1*$|[^\w$@*#+]+$")
#: Cost of an edit by its kind, and the cost that a term of so many letters bears.
LIGHT, FULL = 0.6, 1.0


def cost_limit(letters: int) -> float:
    return 0.0 if letters < 4 else LIGHT if letters < 6 else FULL


def fold(word: str) -> str:
    """Lower case without accents; umlauts as they are written without them, ß as ss."""
    word = word.lower()
    if word.isascii():
        return word
    for a, b in (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        word = word.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def plain_spelling(token: str) -> str:
    """Folded token without invisible characters, outer punctuation, full width and look-alikes."""
    if not token.isascii():
        token = unicodedata.normalize("NFKC", _INVISIBLE.sub("", token))
        token = "".join(map(plain_letter, token))
    token = fold(_EDGE.sub("", token))
    while len(token) > 2 and token[0] == token[-1] and token[0] in "*_#":
        token = token[1:-1]
    return token


def _single(word: str) -> str:
    """Runs of a letter as one."""
    return re.sub(r"(.)\1+", r"\1", word)


def _readings(token: str) -> list[str]:
    """The token's letters, signs read as letters and marks between letters left out, runs as one; for the test before the walk."""
    if token.isalpha():
        return [_single(token)]
    out = [""]
    for c in token:
        of = LEET.get(c, c if c.isalpha() else "")
        if len(of) > 1:
            out = [x + o for x in out for o in of][:8]
        else:
            out = [x + of for x in out]
    return [_single(x) for x in out]


def _fewer(one: str) -> Iterator[str]:
    """The word, its runs as one, and what is left of it without one letter."""
    yield one
    for i in range(len(one)):
        yield one[:i] + one[i + 2 :] if 0 < i < len(one) - 1 and one[i - 1] == one[i + 1] else one[:i] + one[i + 1 :]


class Trie:
    """Lexicon trie with a weighted Levenshtein automaton over it.

    A state of the automaton is the row of least costs of reaching each place of the token; walking down the trie advances the
    state by one letter. Free are: the same letter, a sign that may stand for it, a wild sign, further ones of a stretched letter (three in
    a row or more) and marks between letters. A vowel left out, two letters exchanged, v for u, x for a letter and a doubled letter cost LIGHT, any other edit FULL.
    """

    def __init__(self, terms: dict[str, list[tuple[str, float]]]) -> None:
        self.root: dict = {}
        self.terms = terms
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
        self.longest = max(map(len, terms), default=0)
        self.near: dict[str, set[str]] = {}  # what is left of a term without one letter -> beginnings of such terms
        for t in terms:
            one = _single(t)
            keys = {one}
            if len(t) > 3:
                keys |= {*_fewer(one), *(_single(t[:i] + t[i + 1 :]) for i in range(len(t)))}
            for key in keys:
                self.near.setdefault(key, set()).add(t[:2])

    def beginnings(self, token: str) -> set[str]:
        """First two letters of all terms that a walk may find: readings and terms agree after dropping one letter or none from each."""
        near = self.near
        out: set[str] = set()
        for r in _readings(token):
            if len(r) <= self.longest + 1:
                for key in _fewer(r):
                    if key in near:
                        out |= near[key]
        return out

    def may_match(self, token: str) -> bool:
        return bool(self.beginnings(token))

    def matches(self, token: str, limit: float = FULL, beginnings: set[str] | None = None) -> list[tuple[float, str]]:
        """(cost, term) of all terms within the cost that they bear and ``limit``; only of terms with these beginnings, if given."""
        n = len(token)
        free = [0.0] * (n + 1)  # cost of passing over the token's letter i (1-based)
        for i in range(1, n + 1):
            t = token[i - 1]
            again = i > 1 and t == token[i - 2]
            run = again and (i > 2 and token[i - 3] == t or i < n and token[i] == t)
            free[i] = 0.0 if t in _BETWEEN or run else LIGHT if again else FULL
        first = [0.0] * (n + 1)
        for i in range(1, n + 1):
            first[i] = first[i - 1] + (0.0 if token[i - 1] in _BETWEEN else FULL)
        found = []
        letters = None if beginnings is None else {b[:1] for b in beginnings}
        stack = [(c, node, "", first, None) for c, node in self.root.items() if c and (letters is None or c in letters)]
        while stack:
            c, node, before, row, above = stack.pop()
            gone = LIGHT if c in _VOWELS and before or c == before else FULL
            now = [row[0] + gone]
            for j in range(1, n + 1):
                t = token[j - 1]
                if t == c or t in LEET and c in LEET[t] or t in _WILD:
                    step = 0.0
                else:
                    step = LIGHT if t == "v" and c == "u" or t == "x" and before else FULL
                cost = min(row[j - 1] + step, row[j] + gone, now[j - 1] + free[j])
                if above is not None and j > 1 and t == before and token[j - 2] == c and t != c:
                    cost = min(cost, above[j - 2] + LIGHT)
                now.append(cost)
            if min(now) > limit and (above is None or min(row) > limit):
                continue
            term = node.get("")
            if term is not None and now[n] <= min(limit, cost_limit(len(term))):
                found.append((now[n], term))
            if above is None and beginnings is not None:
                stack.extend((d, below, c, now, row) for d, below in node.items() if d and c + d in beginnings)
            else:
                stack.extend((d, below, c, now, row) for d, below in node.items() if d)
        return found


@cache
def lexicon() -> Trie:
    terms: dict[str, dict[str, float]] = {}
    for role, rows in LEXICON.items():
        for weight, language, words in rows:
            for w in words.split():
                w = fold(w).replace("-", "")
                forms = {w} if role in ("worth", "shut_out", "regard") else {w} | {w + e for e in ENDINGS[language] if len(w) > 3 and not w.endswith(e)}
                for form in forms:
                    terms.setdefault(form, {})[role] = max(weight, terms.get(form, {}).get(role, 0.0))
    return Trie({t: sorted(roles.items()) for t, roles in terms.items()})


@cache
def own_words(paths: tuple[str, ...] = DEFAULT_VOCABULARIES) -> frozenset[str]:
    """Words of public vocabularies that lie near a term without being one; their number is bounded by the vocabularies'.

    Read by the driver only. A word must have a vowel, so that shortened spellings in a vocabulary don't pass for words.
    """
    words: set[str] = set()
    for path in paths:
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                words |= {w[:-4] for w in json.load(f)["model"]["vocab"] if w.endswith("</w>")}
        else:
            with open(path, "rb") as f:
                pieces = [base64.b64decode(line.split()[0]).decode("utf-8", "replace") for line in f]
            words |= {p[1:] for p in pieces if p[:1] == " "}
    trie = lexicon()
    folded = {fold(w) for w in words if len(w) > 2 and w.isalpha()}
    return frozenset(w for w in folded if w not in trie.terms and not _VOWELS.isdisjoint(w) and trie.may_match(w))


class Matcher(dict):
    """token -> () or ((term, roles, cost), ...); remembers tokens up to a fixed number."""

    LIMIT = 600_000

    def __init__(self, words: frozenset[str], fuzzy: bool = True) -> None:
        super().__init__()
        self.trie, self.words, self.fuzzy = lexicon(), words, fuzzy
        self.company: dict[str, list[str]] = {}
        for role, of in COMPANY.items():
            for w in of.split():
                self.company.setdefault(fold(w), []).append(role)

    def __missing__(self, token: str):
        if len(self) > self.LIMIT:
            self.clear()
        value = self[token] = self.look(token)
        return value

    def look(self, token: str) -> tuple:
        """(plain word, term, roles with weights)."""
        word = plain_spelling(token)
        if not word:
            return ("", "", ())
        term = self.term_of(word)
        if not term and not word.isalpha():  # words joined by marks
            for part in _WORDS_OF.findall(word):
                if part != word and len(part) > 3 and (term := self.term_of(part, FULL if len(part) > 5 else 0.0)):
                    word = part
                    break
        roles = list(self.trie.terms[term]) if term else []
        roles += [(r, 0.0) for r in self.company.get(word, ()) or self.company.get(term, ())]
        if _PEOPLE.match(_NO_LETTER.sub("", token)) and not term and word not in self.company and len(word) > 4:
            roles.append(("people", 0.0))
        return (word, term, tuple(roles))

    def term_of(self, word: str, limit: float = FULL) -> str:
        """The nearest term of the word, by the automaton; an edited one only if the word isn't one of its own."""
        trie = self.trie
        if not self.fuzzy:
            return word if word in trie.terms else ""
        letters = sum(map(str.isalpha, word))
        signs = sum(c in LEET or c in _WILD for c in word)
        if letters < 2 or letters < signs or letters + signs < len(word) - sum(c in _BETWEEN for c in word):
            return ""
        beginnings = None
        if word not in trie.terms:
            if word in self.words or word in self.company or word.isdigit():
                return ""
            if _WILD.isdisjoint(word) and not (beginnings := trie.beginnings(word)):
                return ""
        else:
            beginnings = {word[:2]}
        if len(word) > 3 * trie.longest:  # shorten stretches before any walk
            word = re.sub(r"(.)\1{3,}", r"\1\1\1", word)
            if len(word) > 3 * trie.longest:
                return ""
        found = trie.matches(word, limit, beginnings)
        if not word.isalpha() or _WILD & set(word):  # a sign may stand for a letter, not for most of a term
            found = [(c, t) for c, t in found if sum(x.isalpha() for x in set(word)) >= 2 and (len(t) > 3 or c == 0 and word.isalpha())]
        exact = [(c, t) for c, t in found if t == word]
        return min(exact or [(c, -max(w for _, w in trie.terms[t]), t) for c, t in found], default=(0.0, ""))[-1]


_matchers: dict[frozenset, Matcher] = {}


def matcher(words: frozenset[str]) -> Matcher:
    """The worker's matcher, kept from batch to batch."""
    return _matchers.get(words) or _matchers.setdefault(words, Matcher(words))


_SENTENCE_END = (".", "!", "?", "…", '."', '!"', "!!1", "...", "!1", ".)", "?)")
_QUOTES = "\"“”„«»‘‚"


def tokens_of(text: str) -> list[str]:
    """Tokens between white space, cut further at commas, slashes, brackets and quotation marks that stand inside; quotation marks
    at the edges stay, and so do the marks at the end of a sentence."""
    out: list[str] = []
    for raw in _SPACED.sub(lambda m: m.group().replace(" ", ""), text).split():
        inner = raw.strip(_QUOTES + ".,;:!?…()[]")
        if _PARTS.search(inner):
            parts = [p for p in _PARTS.split(raw) if p]
            out += [*parts[:-1], parts[-1]] if parts else []
        else:
            out.append(raw)
    return out


def _around(tokens: list[str], i: int, reach: int) -> tuple[int, int]:
    """First and last token of the sentence of token i, at most ``reach`` tokens away."""
    lo = hi = i
    while lo > 0 and i - lo < reach and not tokens[lo - 1].endswith(_SENTENCE_END):
        lo -= 1
    while hi < len(tokens) - 1 and hi - i < reach and not tokens[hi].endswith(_SENTENCE_END):
        hi += 1
    return lo, hi


def window_scores(tokens: list[str], lo: int, hi: int, find: Matcher) -> dict[str, float]:
    """Scores of the window by kind, from the roles that meet in it."""
    looks = [find[t] for t in tokens[lo : hi + 1]]
    words = [w for w, _, _ in looks]
    weight: dict[str, float] = dict.fromkeys((*LEXICON, *COMPANY, "people"), 0.0)
    held: dict[str, set[str]] = {}
    at: dict[str, list[int]] = {}
    for i, (word, term, roles) in enumerate(looks):
        if term in _TECHNICAL and not _TECHNICAL[term].isdisjoint(words[max(0, i - 2) : i + 3]):
            continue
        for role, w in roles:
            name = term or word
            if name not in held.setdefault(role, set()):
                held[role].add(name)
                weight[role] += w
            at.setdefault(role, []).append(i)
    has = at.__contains__
    near = lambda a, b, reach, ordered=True: any(0 < y - x <= reach if ordered else 0 < abs(y - x) <= reach for x in at.get(a, ()) for y in at.get(b, ()))
    you = 0.3 * has("you")
    target = has("you") or has("person") or has("group") or has("people")
    group = 0.5 * (has("group") or has("people"))
    slights = weight["slight"] + 0.75 * weight["beast"]
    insult = weight["abuse"]
    if insult or target:
        insult += slights + (you or 0.15 * has("person") if slights or insult else 0.0) + (0.2 * has("like") if slights else 0.0)
        insult += 0.3 * (slights > 0 and has("worth") and has("like"))
    # harm to the one spoken to: "break your neck", "I hope you die"
    if near("harm", "thee", 2) and (has("first") or has("wish")) or has("you") and near("harm", "limb", 3) or near("wish", "you", 2) and near("you", "die", 3):
        insult += 0.5 + max(weight["harm"], weight["die"]) + weight["limb"]
    if near("not", "regard", 3) and near("regard", "thee", 2, False):
        insult += 0.3 + weight["regard"]
    hate = weight["hate"]
    meant = has("wish") or has("not")
    if group or has("them") and (weight["beast"] + weight["hate"] > (0.55 if weight["shut_out"] else 0.6)):
        denied = weight["worth"] if has("not") or weight["harm"] else 0.0
        loaded = weight["beast"] + 0.75 * weight["slight"] + weight["harm"] + denied + 0.2 * (weight["harm"] > 0 and meant)
        away = weight["shut_out"] if weight["shut_out"] >= 0.45 or weight["harm"] > 0 else 0.0
        loaded += away if hate or loaded or meant or has("them") else 0.5 * away
        if hate + loaded >= 0.45:
            hate += loaded + group + 0.2 * has("them") + 0.2 * (has("not") and denied > 0)
    if has("them") and has("not") and has("worth") and (weight["beast"] or weight["hate"]):
        hate += 0.2
    if "waste" in held.get("worth", ()) and not {"oxygen", "breathe"}.isdisjoint(held["worth"]):
        hate += 0.5 + 0.3 * (target or has("them"))
    sexual = weight["explicit"]
    bare = weight["body"] + weight["touch"] + weight["sweet"]
    if sexual or weight["body"] or weight["touch"] + weight["sweet"] >= 0.7:
        company = has("own") or has("send") or weight["body"] > 0.6 or sexual
        if company:
            sexual += bare + 0.15 * has("own") + 0.15 * has("send")
    spoken = len(SPOKEN_OF.intersection(words))
    marks = sum(t[:1] in _QUOTES and len(t) > 1 for t in tokens[lo : hi + 1])
    away = min(2, spoken) + (1.0 if marks and not REPORTS.isdisjoint(words) else 0.5 * (marks > 0))
    return {k: v - away for k, v in (("insult", insult), ("hate", hate), ("sexual", sexual))}


def score_text(text: str, find: Matcher, window: int = 14) -> tuple[float, str, int]:
    """(score, kind, passages) of a text: the worst window's score, its kind, and how many windows reach 1."""
    tokens = tokens_of(text)
    best, best_kind, passages, last_end = 0.0, "", 0, -1
    for i, t in enumerate(tokens):
        if not any(r in _SCORING for r, _ in find[t][2]):
            continue
        lo, hi = _around(tokens, i, window)
        scores = window_scores(tokens, lo, hi, find)
        kind = max(scores, key=scores.__getitem__)
        if scores[kind] > best:
            best, best_kind = scores[kind], kind
        if scores[kind] >= 1.0 - 1e-9 and i > last_end:
            passages += 1
            last_end = hi
    return round(best, 6), best_kind, passages


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, ...] = DEFAULT_VOCABULARIES) -> DataFrame:
    """(doc_id, score, kind, passages): one row per document with an id; repeated rows count once. Null and empty texts score 0; a
    passage counts from 1 on. ``vocabularies`` are the files of public tokenizers that tell words of their own from misspelled terms."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    words = own_words(tuple(vocabularies))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = matcher(words)
        for b in batches:
            rows = [score_text(t, find) if t else (0.0, "", 0) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], names=["doc_id", "score", "kind", "passages"])

    return slim.mapInArrow(run, "doc_id bigint, score double, kind string, passages int").distinct()


def source_rates(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """(source, n_documents, n_abusive, rate): per source, null being a source of its own."""
    both = docs.select("doc_id", "source").distinct().join(scores, "doc_id")
    return both.groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if(F.col("passages") > 0).alias("n_abusive"), F.avg(F.when(F.col("passages") > 0, 1.0).otherwise(0.0)).alias("rate"))
