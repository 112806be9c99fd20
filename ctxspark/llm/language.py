"""The language of short texts by profiles of characters.

Each language with a Latin script has a Markov chain over characters, fitted to a short public text and its commonest words, and a share of
probability for these words as such. A text's languages are compared by what their chains give its words; words of a script of their own decide by it.
Names tell nothing of the language they stand in, so capitalised words count only if they are common words of some language.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np

# Article 1 of the Universal Declaration of Human Rights and the commonest words, by language.
PROFILES = {
    "en": (
        "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
        "the a an of to in and is was were are be been has have had that which who what when where why how it its this these those for with by from at on as not but or they them their did does do can could will would should may you your i me my we our us he she his her him yet while until before after during so most each there here than then into over under between about just also only very more other some such up out if no all one two three first last new most many much said says called held kept lost moved found near because since still such both give list write explain compare name describe summarise return answer text question use read according",
    ),
    "de": (
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
        "der die das den dem des ein eine einen einem einer eines und ist war wurde wurden wird werden sind hat haben hatte nicht mit von vom zu zum zur im in an am auf für als wie was wer wo wann warum welche welcher viele bei nach aus doch noch dass sie er es ich wir ihr ihm ihn mich mir uns neben weit aber oder wenn nur auch sich um über unter durch ohne gegen seit vor zwischen kein keine sehr schon dann da diese dieser dieses kann kam ging laut lautet",
    ),
    "es": (
        "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
        "el la los las un una unos unas de del al y e en que se es son era fue fueron ser está están con por para como más pero su sus lo le les me mi yo cuál dónde qué cuántos cuántas quién cómo según cuando junto cerca sin quedó después no ni sí ya muy también entre hasta desde sobre porque hay este esta esto ese esa antes donde todo todos ha había puede",
    ),
    "fr": (
        "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
        "le la les l un une des du de d à et en que qu qui est sont était étaient a ont avait dans pour par avec sur au aux ne n pas mais où quel quelle combien ce cet cette ces il elle ils elles on je j nous vous se s sa son ses leur près quand selon après avant sans non loin reste plus très aussi comme si ou donc y être fait entre sous",
    ),
    "pt": (
        "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
        "o a os as um uma uns umas de do da dos das no na nos nas em e que se é são foi foram era com por para como mais mas ao à aos não qual onde quantos quantas quem segundo quando perto junto sem ficou ficaram depois há seu sua seus suas ele ela eles elas eu me muito também entre até desde sobre porque já ou nem antes está pelo pela",
    ),
    "it": (
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
        "il lo la i gli le un uno una di del della dei delle dello degli al alla ai e ed che è sono era erano nel nella nei con per come più ma non quale dove quanti chi secondo quando vicino senza dopo da dal dalla su sul si ci mi ti ha hanno aveva o anche molto tra fra fino perché questo questa prima loro suo sua",
    ),
    "nl": (
        "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
        "de het een en van in is was waren zijn heeft hebben had niet met voor op te aan door bij naar uit om over onder tegen tussen zonder dat die dit deze wie wat waar wanneer waarom hoe welke ik jij hij zij we wij u ze er maar of ook nog al als dan toen werd werden wordt worden geen hun haar kan zou meer veel na volgens",
    ),
    "sv": (
        "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap.",
        "och i att det som en ett på är var av för med den de till inte om har hade men från vid han hon jag vi ni du sig så kan ska skulle när hur vad vem vilken vilka där här efter före mellan under utan också mycket många eller sin sitt sina deras blev blir bara nu än mot enligt",
    ),
    "da": (
        "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd.",
        "og i at det som en et på er var af for med den de til ikke om har havde men fra ved han hun jeg vi I du sig så kan skal skulle når hvordan hvad hvem hvilken hvor der her efter før mellem under uden også meget mange eller sin sit deres blev bliver kun nu end mod ifølge",
    ),
    "pl": (
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "i w z na do nie się to jest był była było były są że o od za po przez przy dla jak co kto gdzie kiedy dlaczego ile który która które ale lub oraz tak już tylko jego jej ich ja my on ona oni ten ta te tego tej być ma może można bardzo także między bez pod nad przed według",
    ),
    "cs": (
        "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
        "a v na se je že to s z do o k i za by jako pro ale jsou byl byla bylo byly není ne od po při u nebo co kdo kde kdy proč jak který která které jeho její jejich já my on ona ten ta jen už také velmi mezi bez pod nad před podle může",
    ),
    "ro": (
        "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității.",
        "și în de la cu pe a al ale un o este sunt era erau că nu să se din pentru prin după fără între sub peste mai dar sau dacă când cine ce unde cum care câte eu noi el ea ei lor său sa fost foarte numai aici acest această conform",
    ),
    "hu": (
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
        "a az és hogy nem is egy van volt voltak lesz de ez azt ezt mint meg ha csak már még ki mi hol mikor miért hogyan melyik mennyi én te ő mi ti ők vagy el fel le be után előtt között nélkül alatt szerint nagyon minden",
    ),
    "fi": (
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "ja on ei se että oli olivat ovat hän minä me he kun mutta tai jos niin kuin myös vain jo vielä mitä kuka missä milloin miksi miten mikä sen sitä tämä nämä hänen ole olla voi jälkeen ennen ilman välillä mukaan hyvin kaikki",
    ),
    "tr": (
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
        "ve bir bu da de için ile çok daha en olarak olan gibi ama ya ne kim nerede neden nasıl hangi kaç ben sen o biz siz onlar değil var yok idi oldu olduğu sonra önce kadar göre her şey mi",
    ),
    "id": (
        "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan.",
        "yang dan di itu dengan untuk dari tidak ini dalam pada adalah akan ke oleh atau juga sudah ada saya kami kita dia mereka anda apa siapa mana kapan mengapa bagaimana berapa karena jika tetapi setelah sebelum antara tanpa menurut lebih sangat",
    ),
}
# Names of languages, in several of them.
NAMES = {
    "en": "english inglés inglês anglais englisch английском inglese engels engelska angielski 英语 英文",
    "de": "german alemán alemão allemand deutsch немецком tedesco duits tyska niemiecku 德语 德文",
    "es": "spanish español espanhol espagnol spanisch испанском castellano spagnolo spaans spanska hiszpańsku 西班牙语",
    "fr": "french francés francês français französisch французском francese frans franska francusku 法语 法文",
    "pt": "portuguese portugués português portugais portugiesisch португальском portoghese portugees 葡萄牙语",
    "it": "italian italiano italien italienisch итальянском italiaans 意大利语",
    "nl": "dutch neerlandés holandés neerlandês néerlandais niederländisch нидерландском olandese nederlands holländska",
    "sv": "swedish sueco suédois schwedisch шведском svedese zweeds svenska szwedzku",
    "da": "danish danés dinamarquês danois dänisch датском danese deens dansk danska",
    "pl": "polish polaco polonais polnisch польском polacco pools polski polsku polska",
    "cs": "czech checo tcheco tchèque tschechisch чешском ceco tsjechisch čeština česky",
    "ro": "romanian rumano romeno roumain rumänisch румынском rumeno roemeens română",
    "hu": "hungarian húngaro hongrois ungarisch венгерском ungherese hongaars magyar magyarul",
    "fi": "finnish finlandés finlandês finnois finnisch финском finlandese fins suomi suomeksi",
    "tr": "turkish turco turc türkisch турецком turks türkçe",
    "id": "indonesian indonesio indonésien indonesisch indonesia",
    "ru": "russian ruso russo russe russisch русском по-русски ryska rosyjsku 俄语",
    "uk": "ukrainian ucraniano ukrainien ukrainisch украинском українською",
    "zh": "chinese chino chinês chinois chinesisch китайском cinese 中文 汉语",
    "ja": "japanese japonés japonês japonais japanisch японском giapponese 日语 日本語",
    "ko": "korean coreano coréen koreanisch корейском 한국어",
    "ar": "arabic árabe arabe arabisch арабском arabo العربية",
}
# Scripts that tell a language by themselves.
_SCRIPTS = [("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[一-鿿]")), ("ko", re.compile("[가-힯]")), ("ar", re.compile("[؀-ۿ]")), ("he", re.compile("[֐-׿]")), ("hi", re.compile("[ऀ-ॿ]")), ("th", re.compile("[฀-๿]")), ("el", re.compile("[Ͱ-Ͽ]"))]
_CYRILLIC, _UKRAINIAN, _RUSSIAN = re.compile("[Ѐ-ӿ]"), re.compile("[іїєґІЇЄҐ]"), re.compile("[ыэёъЫЭЁЪ]")
_NAMED = {k: re.compile("|".join(rf"(?<!\w){re.escape(n)}(?!\w)" if ord(n[0]) < 0x3000 else re.escape(n) for n in v.split())) for k, v in NAMES.items()}
_LETTERS = re.compile(r"[^\W\d_]+")
LANGUAGES = tuple(PROFILES)
COMMON = {k: frozenset(w.lower().split()) for k, (_, w) in PROFILES.items()}
ANY_COMMON = frozenset().union(*COMMON.values())
#: What one word may say against a language at most; how much better, in nats, the language of a text must be than another; how many common
#: words of its language that the other has not must be in it, as lists of names and borrowed words are in none.
WORST, MARGIN, EVIDENCE = 6.0, 5.0, 2


def _chain(text: str, common: str) -> tuple[Counter, Counter, Counter, Counter]:
    words = [f"^{w}$" for w in _LETTERS.findall(text.lower())] * 2 + [f"^{w}$" for w in common.lower().split()]
    grams = [Counter(w[i - n : i + 1] for w in words for i in range(max(1, n), len(w))) for n in range(3)]
    return grams[0], grams[1], grams[2], Counter(w[i - 2 : i] for w in words for i in range(2, len(w)))


_CHAINS = [_chain(*p) for p in PROFILES.values()]
_FIRST = [Counter() for _ in _CHAINS]
for _c, _f in zip(_CHAINS, _FIRST):
    for _pair, _n in _c[1].items():
        _f[_pair[0]] += _n


@lru_cache(1 << 18)
def _word(w: str) -> np.ndarray:
    """How much worse than in the likeliest language the word is in each, at most WORST."""
    s = f"^{w}$"
    out = np.empty(len(LANGUAGES))
    for k, (one, two, three, pairs) in enumerate(_CHAINS):
        total, first = sum(one.values()), _FIRST[k]
        p = 0.0
        for i in range(1, len(s)):
            a = (one[s[i]] + 0.05) / (total + 0.05 * 200)
            b = (two[s[i - 1 : i + 1]] + 4 * a) / (first[s[i - 1]] + 4)
            c = (three[s[i - 2 : i + 1]] + 3 * b) / (pairs[s[i - 2 : i]] + 3) if i > 1 else b
            p += math.log(c)
        common = COMMON[LANGUAGES[k]]
        out[k] = np.logaddexp(p + math.log(0.5), math.log(0.5 / len(common)) if w in common else -math.inf)
    return np.maximum(out - out.max(), -WORST)


def scores(text: str) -> np.ndarray | None:
    """The languages' summed scores of a text's distinct words, 0 at best; None without words to tell by."""
    if not any(map(str.islower, text)):
        text = text.lower()
    seen = {w.lower() for w in _LETTERS.findall(text) if w[0].islower() or w.lower() in ANY_COMMON}
    total = np.zeros(len(LANGUAGES))
    for w in seen:
        total += _word(w)
    return total if seen else None


def script(text: str) -> str | None:
    """The language that a script of its own says, if that makes up a fifth of the letters."""
    letters = sum(map(str.isalpha, text))
    for name, chars in _SCRIPTS:
        n = len(chars.findall(text))
        if n >= 2 and n * 5 >= letters:
            return name
    n = len(_CYRILLIC.findall(text))
    if n >= 2 and n * 5 >= letters:
        return "uk" if len(_UKRAINIAN.findall(text)) > len(_RUSSIAN.findall(text)) else "ru"
    return None


def language(text: str, margin: float = MARGIN) -> str | None:
    """The language of a text, or None if it doesn't say."""
    own = script(text)
    if own or not text:
        return own
    s = scores(text)
    if s is None:
        return None
    order = np.argsort(-s, kind="stable")
    return LANGUAGES[order[0]] if s[order[0]] - s[order[1]] >= margin else None


def differ(answer: str, question: str, allowed: set[str] = frozenset()) -> str | None:
    """The answer's language if the question is surely in another one and the answer surely in none of those allowed."""
    a, q = script(answer), script(question)
    if a or q:
        a, q = a or language(answer), q or language(question, MARGIN / 2)
        return a if a and q and a != q and a not in allowed else None
    sa, sq = scores(answer), scores(question)
    if sa is None or sq is None:
        return None
    i, j = int(sa.argmax()), int(sq.argmax())
    # each is clearly better in its own language than in the other's
    if i == j or sa[i] - sa[j] < MARGIN or sq[j] - sq[i] < MARGIN / 2:
        return None
    if any(sa[LANGUAGES.index(x)] >= sa[i] - MARGIN for x in allowed if x in COMMON):
        return None
    own = COMMON[LANGUAGES[i]] - COMMON[LANGUAGES[j]]
    if LANGUAGES[j] == "en" and "i" in COMMON[LANGUAGES[i]]:
        own = own | {"i"}  # in English a capital
    words = set(_LETTERS.findall(answer))
    return LANGUAGES[i] if len({w.lower() for w in words if w in own or w.lower() in own and w != "I"}) >= EVIDENCE else None


def asked(text: str) -> set[str]:
    """Languages that a text names."""
    low = text.lower()
    return {k for k, p in _NAMED.items() if p.search(low)}
