"""Refusals, by aligning sentences with templates of word classes.

A refusal says who (a first person), that it can't or won't, and what it doesn't do (answer, help, tell). The template
is aligned with a sentence wherever these three stand near one another; the gaps between them are what the alignment costs.
Shorter templates are of verbs that decline by themselves, of things said to be barred and of answers that will not be given.
A text refuses if it has such a sentence and tells nothing besides: what else there is only speaks of the speakers or of rules.
"""

from __future__ import annotations

import re

_WORD = re.compile(r"[^\W_]+")
_APOSTROPHE = re.compile(r"(?<=\w)['’](?=t\b|m\b|d\b|ve\b|re\b|ll\b|s\b)")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]")
SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)]*\s+|(?<=[。！？])\s*|\n+")
_CLAUSE = re.compile(SENTENCE.pattern + r"|(?<=[:;])\s+")
#: Words that may stand between two parts of a template, and in all its gaps together.
GAP, GAPS = 5, 9

# Word classes by language. Those of ACTS and BARRED are beginnings of words.
FIRST = {
    "en": "i im ive id ill me my we our us myself",
    "de": "ich mir mich mein meine wir uns",
    "es": "yo me mi mis nos puedo podemos debo quiero voy prefiero estoy soy siento lamento tengo podré pudiera",
    "fr": "je j moi mon ma mes nous me m",
    "pt": "eu me meu minha posso podemos devo quero vou prefiro estou sou sinto lamento tenho poderei",
    "it": "io mi mio mia posso possiamo devo voglio vorrei preferisco sono sento spiace dispiace intendo",
    "nl": "ik mij me mijn wij we ons",
    "pl": "ja mi mnie mogę możemy chcę będę wolę jestem przykro mogłbym mogłabym zamierzam",
    "sv": "jag mig min mitt vi oss",
    "da": "jeg mig min mit vi os",
    "ru": "я мне мой мы нам могу можем буду хочу предпочитаю",
}
NOT = {
    "en": "cannot cant not wont dont doesnt isnt unable never unwilling wouldnt couldnt shouldnt arent neither nor no",
    "de": "nicht kein keine keinen keiner nie niemals",
    "es": "no nunca tampoco ningún ninguna",
    "fr": "ne n pas jamais aucune aucun",
    "pt": "não nunca nem nenhuma nenhum",
    "it": "non mai nessuna nessun",
    "nl": "niet geen nooit",
    "pl": "nie nigdy",
    "sv": "inte ej aldrig ingen inga",
    "da": "ikke aldrig ingen",
    "ru": "не нельзя никогда никакой",
}
ACTS = {
    "en": "answer help assist provid shar give giving comment respond reply replying comply talk speak discuss tell say write writing engag fulfil generat reveal disclos address continu proceed participat do doing offer weigh complet advis support access read open produc cover elaborat go going creat",
    "de": "helf weiterhelf beantwort antwort auskunft geben gebe sagen sage teilen mitteil äußer sprech reden besprech kommentier unterstütz nachkomm erfüll bereitstell dienen",
    "es": "ayud respond contest dar darle darte proporcion compart habl decir decirle decirte coment discut ofrec facilit complac revel cumpl hacer",
    "fr": "aider aide répond donner fourn partag parler dire comment discut offrir communiqu révél satisfaire traiter faire",
    "pt": "ajud respond dar fornec partilh compartilh falar dizer coment discut oferec revel cumpr atend fazer",
    "it": "aiut rispond dare darti forn condivid parlar dire dirti comment discut offr rivel soddisf fare farlo assist",
    "nl": "helpen help beantwoord antwoord geven geef zeggen zeg delen deel bespreek bespreken verstrek reageer reageren vertel praten",
    "pl": "pomóc pomo pomag odpowi udziel poda mówić powiedzie komentow dzieli rozmawia ujawni spełni",
    "sv": "hjälp svara ge säga dela diskut kommenter tala berätt lämna uppfyll",
    "da": "hjælp svare give sige dele diskut kommenter tale fortæl oplys opfyld",
    "ru": "помо ответ отвеч говор сказать дать дава обсужд предостав сообщ коммент рассказ выполн",
}
DECLINES = {
    "en": "refuse decline abstain refrain pass",
    "de": "verweigere lehne weigere verzichte",
    "es": "rehúso niego rechazo declino abstengo",
    "fr": "refuse décline abstiens",
    "pt": "recuso rejeito declino abstenho",
    "it": "rifiuto declino astengo",
    "nl": "weiger",
    "pl": "odmawiam",
    "sv": "vägrar avböjer avstår",
    "da": "nægter afslår afviser",
    "ru": "отказываюсь отказываемся воздержусь",
}
BARRED = "outside beyond against restrict prohibit forbid forbidden inappropriate unsafe violat disallow confidential vertraulich untersagt unzulässig prohibid confiden interdit inappropri proibid vietat riservat verboden vertrouwelijk zabronion poufn förbjud запрещ конфиденц"
TOPICS = "request question topic prompt query subject that this matter inquiry anfrage frage thema pregunta solicitud tema question demande sujet pergunta pedido domanda richiesta argomento vraag verzoek onderwerp pytanie temat fråga begäran ämne вопрос тема запрос"
RULES = "guideline polic rule programming instruction safety richtlinie regel norma polític regla directive règle regra diretri linee regole politic richtlijn beleid zasad riktlinj regler правил"
PREVENTS = "break breach violat against prevent prohibit forbid stop allow permit verbiet erlaub hinder impid prohíb permit interdi empêch permett impede proíb vieta permette verbied staat zabrania pozwala förbjud tillåt hindrar запрещ позвол"
# Words for an answer, and for that one is given; "no answer will be given".
ANSWERS = "answer response reply information help assistance details comment antwort auskunft respuesta información réponse resposta risposta antwoord odpowiedź svar ответ"
GIVEN = "given provided offered available possible forthcoming shared erteilt gegeben dada ofrecida donnée fournie dado data fornita gegeven udzielona ges дан"
# What speaks to the reader or of the exchange itself and so tells nothing of the matter.
SPEECH = "you your yours please sorry thank thanks apologize apologise apologies unfortunately regrettably sie ihnen ihr bitte leider danke entschuldigung usted ustedes gracias consulte disculpe disculpa vous votre merci désolé excusez hélas você obrigado obrigada desculpe consulte infelizmente lei voi grazie scusa scusi purtroppo je jij u uw bedankt helaas dziękuję przepraszam proszę niestety du dig er tack tyvärr tak desværre вы вам ваш извините простите спасибо пожалуйста сожалению"
# Scripts without spaces between words, as whole phrases.
_PHRASES = re.compile(r"(?:我|本人|我们)?\s*(?:不能|无法|不可以|不便|不愿|拒绝)[^。！？，,]{0,12}(?:回答|帮助|提供|协助|讨论|分享|评论|满足|透露)|(?:お答え|回答|お手伝い|お応え|ご案内|提供)[^。！？]{0,8}(?:できません|できかねます|いたしかねます)|お断り(?:します|いたします)|(?:답변|도와|제공|대답|말씀)[^.!?]{0,12}(?:수 없|어렵|거절)")
_NO = frozenset("no nein non não nee nie nej нет".split())


def words(text: str) -> list[str]:
    return _WORD.findall(_APOSTROPHE.sub("", text.lower()))


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


def _stems(text: str) -> re.Pattern:
    return re.compile("(?:" + "|".join(sorted(set(text.split()), key=len, reverse=True)) + ")")


_CLASSES = {k: (_set(FIRST[k]), _set(NOT[k]), _stems(ACTS[k]), _set(DECLINES[k])) for k in FIRST}
_FIRSTS = frozenset().union(*(c[0] for c in _CLASSES.values()))
_NOTS = frozenset().union(*(c[1] for c in _CLASSES.values()))
_DECLINES = frozenset().union(*(c[3] for c in _CLASSES.values()))
_BARRED, _TOPICS, _RULES, _PREVENTS = _stems(BARRED), _stems(TOPICS), _stems(RULES), _stems(PREVENTS)
_ANSWERS, _GIVEN, _SPEECH = _set(ANSWERS), _set(GIVEN), _set(SPEECH)


def _is_act(k: str, w: str) -> bool:
    """Beginnings of four letters or more; shorter ones are whole words."""
    m = _CLASSES[k][2].match(w)
    return bool(m) and (len(m.group()) > 3 or m.group() == w)


def refuses(w: list[str]) -> bool:
    """Whether a sentence's words align with a template of a refusal."""
    some = set(w)
    if some & _FIRSTS and any(map(_RULES.match, w)) and any(map(_PREVENTS.match, w)):
        return True
    if not (some & _NOTS or some & _DECLINES or any(map(_BARRED.match, w))):
        return False
    for k, (first, never, _, declines) in _CLASSES.items():
        who = [i for i, x in enumerate(w) if x in first]
        if not who:
            continue
        if any(x in declines and any(0 < i - s <= GAP for s in who) for i, x in enumerate(w)):
            return True
        acts = None
        for n, x in enumerate(w):
            if x not in never:
                continue
            acts = [i for i, y in enumerate(w) if _is_act(k, y)] if acts is None else acts
            # who and what on either side of the negation, in any order, each near the next
            for a in acts:
                for s in who:
                    parts = sorted((n, a, s))
                    gaps = [parts[1] - parts[0] - 1, parts[2] - parts[1] - 1]
                    if len(set(parts)) == 3 and max(gaps) <= GAP and sum(gaps) <= GAPS and (a > n or k in {"de", "nl"}):
                        return True
    if any(c.isdigit() for x in w for c in x):
        return False
    return any(map(_BARRED.match, w)) and bool(some & _FIRSTS or any(map(_TOPICS.match, w))) or bool(some & _NOTS and some & _ANSWERS and some & _GIVEN)


def tells_nothing(sentence: str, w: list[str]) -> bool:
    """Whether a sentence speaks of the speakers only: of the first person or to the reader, without figures."""
    if not w or len(w) == 1 and w[0] in _NO:
        return True
    some = set(w)
    if any(c.isdigit() for x in w for c in x):
        return False
    return bool(some & _SPEECH) or w[0] in _FIRSTS or any(map(_RULES.match, w)) and bool(some & _FIRSTS)


def is_refusal(text: str) -> bool:
    """Refuses and tells nothing besides. What stands in quotation marks is not said by the speaker."""
    refused = False
    plain = _QUOTED.sub(" ", text).strip()
    for s in _CLAUSE.split(plain):
        w = words(s)
        if _PHRASES.search(s) or refuses(w):
            refused = True
        elif not tells_nothing(s, w):
            return False
    return refused
