import random

import pytest

from folioforge.llm import abuse as A

#: Sentences that the weights were tried on. None of them, nor of the held-out ones, occurs in the data.
TRIED_BAD = """You're nothing but a lazy, useless idiot
Only a brainless fool could have written that report
what an ugly, stinking pig you are
Why don't you just die, nobody here loves you
I will find you and smash your teeth in
Somebody ought to punch you in the nose
Shut your mouth, you filthy liar
He is such a pathetic coward
my boss is a complete wanker
you absolute b1tch
y0u are a st*pid m0r0n
that d.o.u.c.h.e.b.a.g ruined it
your code is garbage and you are garbage
what a cnut
She is a worthless whore
immigrants are parasites
All foreigners are criminals and should be deported
these refugees breed like vermin
The Albanians are a disease, throw them in the sea
muslims have no right to live here
Jews are rats
we should exterminate the gypsies
Women are inferior and should not be allowed to vote
keep the Pakistanis out of our country, they are filth
send those savages back to their cages
lesbians deserve to burn
she spread her legs and licked his throbbing dick
watch horny milfs get naked on webcam
show me your nude body, baby
he kissed her nipples and she moaned
hot naked girls tonight xxx
I want to undress you and kiss your bare skin in bed
send me a sexy picture of your boobs
eres una mierda de persona, idiota
los inmigrantes son escoria
vete a morir, cabrón
quiero follar contigo
enseñame tus tetas
du bist so ein dummer Versager
Die Ausländer sind Abschaum
verrecke endlich, du Schlampe
zeig mir deine Titten
Flüchtlinge sind Parasiten, raus mit ihnen
tu es vraiment un gros connard
les immigrés sont de la racaille
crève, sale batard
ferme ta gueule, imbécile
je veux lécher tes seins
you moooooron
go to hell, asshoel
btch please, you are dumb""".split("\n")
TRIED_FINE = """He paid for the ticket.
Still dreaming of a holiday.
Message me privately about the invoice.
Du bist ein Freund.
tu es un ami
The parasite worm lives in the rat and the snake.
Please kill the job before you reboot the machine.
I hope you can break the task into smaller parts.
The patient's naked skin was examined under hot light.
Sex and age of the participants are listed in table 3.
The women in the study were between 30 and 40 years old.
Breast cancer is a common disease in women.
The cock crowed at dawn on the farm.
The beast of the forest is a story for children.
Immigrants have the right to vote after five years.
The Germans were driven out of the city in 1945.
Rats breed quickly in warm weather.
He wiped the dirty floor and kept the door closed.
The dog bit the man near the fence.
You should never hang the cable near the hot pipe.
Wet clothes dry fast on a hot day.
She took off her coat and went to bed.
The word "bitch" is flagged by our filter.
The moderator removed a comment that called him an "idiot".
The report quotes slurs such as "kike" as examples of hateful words.
We must not ban people for using swear words like 'shit' once.
Our policy forbids terms such as fuck and cunt in names.
The Japanese love sweet rice cakes.
Your deadline will not be missed.
I miss you and love you.
Nobody needs you to restart the server.
The animals in the cages were fed twice a day.
All Italians are invited to the camp.
He deserves a decent meal.
The garbage collector runs every ten minutes.
Dead letters are moved to a queue.
The master and the slave node exchange keys.
A thick film of oil covers the metal.
No human could breathe in that room.
My son was born in the village near the wall.
The engineer is too busy to answer.
What a lovely baby you have!
The sick pig was treated by the vet.
Kiss the bride and cut the cake.
The teacher said that lying is wrong.
Les animaux malades puent parfois.
Los animales del barrio comen basura.
Die Ratten im Lager fressen Getreide.
Le droit de vivre en paix appartient à tous.
Das Recht auf Leben gilt für alle Menschen.
The lazy loading of modules saves time.
Fire may burn you if you touch the stove.
He was beaten at chess by a clever boy.
The fat content of milk is 3.5 per cent.
Crap out of dust was cleaned from the filter.
Scream louder, the hall is big.""".split("\n")
#: Sentences written after the weights were set, and not used since.
HELD_OUT_BAD = """You are the dumbest piece of shit I ever met
That secretary is an incompetent, ugly cow
Your brother is a thieving rat and you know it
what a bunch of morons run this place
I'll break your jaw if you come here again
you disgusting creep, nobody could ever love you
we should hang that bastard
get out of here, you worthless trash
He called you a f a g g o t because you are one
this im8ecile can't even count
shuuuut up, dickheaad
you are a compleet imbicile
Romanians are thieves and liars
Every single refugee is a criminal parasite
blacks are inferior to whites and should not be allowed to vote
burn their mosques and deport all muslims
These subhumans belong in a ghetto
Poles are stinking pigs
Christians deserve death
gas the Jews
Arabs are vermin, exterminate them
free p0rn videos with horny teens
he licked her wet pussy until she came
she was naked on the bed and begged him to fuck her
I jerk off to your sexy nudes
touch my d1ck, baby
eres un payaso patético
los gitanos son ratas, hay que expulsarlos
mándame una foto de tus tetas
que te jodan, hijo de puta
Halt dein dummes Maul, du Versager
Juden sind Ungeziefer
Ich will deine nackten Titten lecken
ces étrangers sont des parasites, dehors
sale pute, va crever
tu es complètement idiot et minable""".split("\n")
HELD_OUT_FINE = """The surgeon removed the tumour from her neck.
Use your finger to press the button.
The Swedes won the game, and the Finns were not pleased.
A stupid mistake in line 4 caused the crash.
The children loved the animals on the farm.
Pigs and dogs were kept behind the fence.
You must shut the valve before you leave.
We beat the deadline by two days.
The dead battery should be replaced by an engineer.
Hot water may choke the pump.
Refugees arrived in the country last week.
The museum shows nude paintings by Italian artists.
The court sentenced the man for murder.
Women are better paid here than in other countries.
Her body of work is large.
Naked singularities are discussed in section 3.
The baby was wet, so she changed his clothes.
A cheap webcam is enough for the meeting.
He was called a liar by the press, the report says.
The user reported the insult "dumb cow" to the moderators.
The kitchen is near the women's room.
The lazy dog lay in the hot sun.
Parasites kill many fish every year.
Foreigners need a visa to live and work in Japan.
The author regrets a lousy translation.
Blood is thicker than water, my mother said.
The prick of a needle is hardly felt.
I love sweet things, honey above all.
Die Tiere im Zoo leben hinter einem Zaun.
Las mujeres tienen derecho a votar.
Les femmes ont le droit de vote depuis 1944.
Der Versuch war nutzlos, weil die Probe alt war.""".split("\n")
TECHNICAL = [
    "A dumb terminal can still execute the explicit flag.", "Kill the zombie process before you restart the key.", "The slave clock follows its master within 5 ms.", "Faults in the tracer are invisible to the naked eye.",
    "The comment filter hides abusive or hateful posts until an editor has seen them.", "No adult content, harassment or slurs may appear in a name.", "Male and female connectors must mate fully.", "The hot swap leaves it bare; screw the panel down afterwards.",
    "Los conectores macho y hembra deben encajar.", "Der Filter verbirgt beleidigende Beitr\u00e4ge bis zur Durchsicht.", "L'horloge esclave suit le ma\u00eetre, c\u00e2ble \u00e0 nu.", "The port shift on the short ship sheet", "", "maxFilterQueue = 4", "El enlace d\u00e9bil despierta",
]
#: The same words in spellings that only the automaton reads.
DISGUISED = [
    "you are a complete m0r0n", "what a dumb4s$ you are", "a bunch of useless scubmags", "you s-c-u-m-b-a-g", "such a giliiiiipollas", "Du bist ein Vollidddddiot", "vid\u00e9os po\u200brno gratuites", "go fvck yourself", "this vendor is a w**ker",
    "\uff35\uff2e\uff27\uff25\uff3a\uff29\uff25\uff26\uff25\uff32 und Abschaumm, diese Juden", "you f" + 25 * "u" + "ck", "btch", "bitxh", "cxnt", "you b!tch", "you m o r o n", "an asshoel", "an imbicile", "dickheaad", "you idiot/mor0n,you",
]


@pytest.fixture(scope="module")
def find():
    return A.Matcher(A.own_words())


@pytest.mark.parametrize("text", TECHNICAL)
def test_technical_text_is_not_abuse(text, find):
    assert A.score_text(text, find)[2] == 0


def _figures(bad, fine, find):
    found, wrong = [t for t in bad if A.score_text(t, find)[2]], [t for t in fine if A.score_text(t, find)[2]]
    return len(found) / len(bad), len(found) / max(1, len(found) + len(wrong))


def test_precision_and_recall(find):
    recall, precision = _figures(TRIED_BAD, TRIED_FINE, find)
    assert recall >= 0.95 and precision >= 0.95
    recall, precision = _figures(HELD_OUT_BAD, HELD_OUT_FINE, find)
    assert recall >= 0.85 and precision >= 0.9


def test_disguised_words_need_the_automaton(find):
    """Ablation: with terms looked up as they stand, nearly all disguised words are lost."""
    plain = A.Matcher(A.own_words(), fuzzy=False)
    assert [t for t in DISGUISED if not A.score_text(t, find)[2]] == []
    assert len([t for t in DISGUISED if A.score_text(t, plain)[2]]) <= len(DISGUISED) // 5  # these are met with plain company


def test_quotation_and_reports_take_from_the_score(find):
    used = A.score_text("you are a moron", find)[0]
    assert used >= 1 > A.score_text('the report quotes "you are a moron" as a banned phrase', find)[0]


def _distance(token, term):
    """The automaton's distance, written as a plain table."""
    n, m = len(token), len(term)
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for j in range(1, m + 1):
        c, before = term[j - 1], term[j - 2] if j > 1 else ""
        d[0][j] = d[0][j - 1] + (A.LIGHT if c in A._VOWELS and before or c == before else A.FULL)
    for i in range(1, n + 1):
        t = token[i - 1]
        again = i > 1 and token[i - 2] == t
        run = again and (i > 2 and token[i - 3] == t or i < n and token[i] == t)
        d[i][0] = d[i - 1][0] + (0.0 if t in A._BETWEEN else A.FULL)
        for j in range(1, m + 1):
            c, before = term[j - 1], term[j - 2] if j > 1 else ""
            same = t == c or c in A.LEET.get(t, "") or t in A._WILD
            swap = 0.0 if same else A.LIGHT if t == "v" and c == "u" or t == "x" and before else A.FULL
            gone = A.LIGHT if c in A._VOWELS and before or c == before else A.FULL
            d[i][j] = min(d[i - 1][j - 1] + swap, d[i][j - 1] + gone, d[i - 1][j] + (0.0 if t in A._BETWEEN or run else A.LIGHT if again else A.FULL))
            if i > 1 and j > 1 and t == before and token[i - 2] == c and t != c:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + A.LIGHT)
    return d[n][m]


def test_automaton_equals_distances():
    trie, rng = A.lexicon(), random.Random(3)
    terms = sorted(trie.terms)
    for _ in range(60):
        token = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(token))
            token[i : i + 1] = rng.choice([[], ["q"], [token[i]] * 3, ["-", token[i]], ["*"], ["3"], [token[i], "a"]])
            token = token or ["a"]
        token = "".join(token)
        got = dict((t, round(c, 6)) for c, t in trie.matches(token))
        want = {t: round(c, 6) for t in terms if (c := _distance(token, t)) <= A.cost_limit(len(t))}
        assert got == want, token
        if want and not set(token) & A._WILD and len(token) > 2:
            assert trie.may_match(token), token


def test_frames(spark):
    bad, fine = HELD_OUT_BAD[0], TECHNICAL[0]
    rows = [(1, bad, "a", 0.5), (1, bad, "a", 0.5), (2, None, "a", None), (3, "", None, None), (None, bad, "a", 1.0), (4, "word " * 50_000 + ". " + bad, "b", 1.0), (5, fine, "b", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")
    scores = A.score_documents(docs)
    assert {r.doc_id: r.passages > 0 for r in scores.collect()} == {1: True, 2: False, 3: False, 4: True, 5: False} and scores.count() == 5
    rates = {r.source: (r.n_documents, r.n_abusive, r.rate) for r in A.source_rates(docs, scores).collect()}
    assert rates == {"a": (2, 1, 0.5), None: (1, 0, 0.0), "b": (2, 1, 0.5)}
    assert A.score_documents(docs.limit(0)).count() == 0
