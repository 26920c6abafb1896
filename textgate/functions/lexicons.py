"""Fixed vocabulary of the text rules: plain data, in evaluation order where order matters."""

from __future__ import annotations

# Screening patterns by family, first match wins.
GATE: list[tuple[str, list[tuple[str, str]]]] = [
    (
        "wordy-phrase",
        [
            ("for the purpose of", r"\bfor the purpose of\b"),
            ("in the majority of", r"\bin the majority of\b"),
            ("on account of the fact", r"\bon account of the fact\b"),
            ("with the exception of", r"\bwith the exception of\b"),
            ("the fact that", r"\bthe fact that\b"),
            ("for a period of", r"\bfor a period of\b"),
            ("in accordance with", r"\bin accordance with\b"),
            ("during the course of", r"\bduring the course of\b"),
            ("in the vicinity of", r"\bin the vicinity of\b"),
            ("in order to/for", r"\bin order (to|for)\b"),
            ("at this point in time", r"\bat (this point in time|the present moment)\b"),
            ("prior to", r"\bprior to\b"),
            ("subsequent to", r"\bsubsequent to\b"),
            ("with regard/respect to", r"\b(with regard to|in regards to|with respect to)\b"),
            ("in the event of/that", r"\bin the event (of|that)\b"),
            ("in close proximity", r"\bin close proximity\b"),
            ("a large/significant number of", r"\ba (large|significant|considerable) number of\b"),
            ("has the ability/capability", r"\b(ha(s|ve|d) the (ability|capability|capacity)|the capability of)\b"),
            ("is able to", r"\b(is|are|was|were|be) able to\b"),
            ("makes use of", r"\bmake(s)? use of\b"),
            ("whether or not", r"\bwhether or not\b"),
            ("each and every", r"\beach and every\b"),
            ("as to whether", r"\bas to whether\b"),
            ("in terms of", r"\bin terms of\b"),
            ("on a daily/weekly basis", r"\bon a \w+ basis\b"),
            ("due to the ... nature of", r"\bdue to the \w+ nature of\b"),
            ("it should be noted", r"\bit should be noted\b"),
            ("it is worth noting", r"\bit is worth not(ing|ed)\b"),
            ("it is important to note", r"\bit is important to note\b"),
            ("give consideration to", r"\bg(i|a)ve(s|n)? consideration to\b"),
            ("the reason being", r"\bthe reason being\b"),
            ("the reason why", r"\bthe reason why\b"),
            ("in the process of", r"\bin the process of\b"),
            ("at the end of the day", r"\bat the end of the day\b"),
            ("going forward", r"\bgoing forward\b"),
            ("in a general sense", r"\bin a general sense\b"),
            ("in light of", r"\bin light of\b"),
            ("in the near future", r"\bin the near future\b"),
            ("make changes to", r"\bmak(e|es|ing) changes to\b"),
            ("with the aim of", r"\bwith the aim of\b"),
            ("in spite of the fact", r"\bin spite of the fact\b"),
            ("owing to the fact", r"\bowing to the fact\b"),
        ],
    ),
    (
        "expletive",
        [
            ("there is a need for", r"\bthere (is|was) a need for\b"),
            ("there is no doubt that", r"\bthere (is|was) no doubt that\b"),
            ("there be X that/who", r"\bthere (is|are|was|were)\s+(a|an|no|many|several|three|four|five|numerous|some)?\s*\w+(\s\w+){0,2}\s+(that|who|which)\b"),
            ("it is ADJ that", r"\bit (is|was) (necessary|essential|important|vital|crucial|clear|evident|apparent|likely|unlikely|possible|probable) that\b"),
            ("it was VERBed that/by", r"\bit (was|has been|had been) (decided|agreed|determined|demonstrated|noted|shown|suggested|reported|observed) (that|by)\b"),
            ("it is our N that", r"\bit (is|was) (our|my|their) \w+ that\b"),
            ("it has come to our attention", r"\bit has come to (our|my) attention\b"),
            ("it seems (to me) that", r"\bit (seems|appears|seemed|appeared) (to (me|us) )?that\b"),
            ("it could be argued", r"\bit (could|can|might) be argued\b"),
            ("there is a chance that", r"\bthere (is|was) a (chance|possibility) that\b"),
            ("there was agreement that", r"\bthere (is|was) (general )?(agreement|consensus) that\b"),
        ],
    ),
    (
        "passive-by-agent",
        [
            ("be PP by AGENT", r"\b(is|are|was|were|be|been|being)\s+(all\s+|\w+ly\s+)?\w+(ed|wn|en|ne|lt|ung|eld|ade|aid|ept|ent|old|uilt|ead|one)\s+by\s+(the|a|an|our|their|its|my)\b"),
        ],
    ),
    (
        "nominalisation",
        [
            ("light-verb + deverbal noun", r"\b(make|makes|made|making|perform|performs|performed|performing|conduct|conducts|conducted|carry|carries|carried|undertake|undertakes|undertook|give|gives|gave|given|provide|provides|provided|reach|reaches|reached|put|puts|take|takes|took)\b(\s+\w+){0,2}?\s+(a|an|the)?\s*\w*(tion|sion|ment|ance|ence|ysis|proposal|review|comparison|approval|mention|warning)s?\b"),
            ("is/are in agreement", r"\b(is|are|was|were) in (agreement|alignment|compliance)\b"),
        ],
    ),
    (
        "hedge-stack",
        [
            ("it seems to me", r"\bit seems to (me|us)\b"),
            ("I would just like to", r"\bi would just like to\b"),
            ("perhaps it might", r"\bperhaps (it|we) (might|may|could)\b"),
            ("could possibly", r"\b(could|might|may) possibly\b"),
            ("may want to consider", r"\b(may|might) want to consider\b"),
            ("arguably (sentence-initial)", r"^arguably,"),
        ],
    ),
    (
        "redundant-pair",
        [
            ("revert back", r"\brevert(s|ed|ing)? back\b"),
            ("advance warning", r"\badvance (warning|planning|notice)\b"),
            ("consensus of opinion", r"\bconsensus of opinion\b"),
            ("cooperate together", r"\b(cooperat|collaborat|join|merg)\w* together\b"),
            ("brand new", r"\bbrand new\b"),
            ("end result", r"\bend result\b"),
            ("final outcome", r"\bfinal outcome\b"),
            ("exact same", r"\bexact same\b"),
            ("repeat ... again", r"\brepeat\b[^.?!]{0,25}\bagain\b"),
            ("plan ahead", r"\bplan(s|ned|ning)? ahead\b"),
            ("complete(ly) and total(ly)", r"\bcomplete(ly)? and total(ly)?\b"),
            ("basic fundamentals", r"\bbasic fundamentals\b"),
            ("past history / future plans", r"\b(past history|future plans|added bonus|unexpected surprise)\b"),
        ],
    ),
    (
        "relative-bloat",
        [
            ("which/that/who + be", r"\b(which|that|who) (is|are|was|were)\b"),
        ],
    ),
    (
        "run-on-coordination",
        [
            ("chained pronoun clauses", r"\b(and|but|or)\s+(then\s+)?(we|it|they|i)\b[^.?!]{0,160}\b(and|but|or)\s+(then\s+|after that\s+)?(we|it|they|i)\b"),
            ("repeated subordinator", r"\b(because|if|after|although|when)\b[^,.;]{3,60}\band\s+(because|if|after|although|when)\b"),
        ],
    ),
    (
        "parallelism-fault",
        [
            ("mixed gerund/infinitive/that list", r",\s*(to\s+\w+|that\s+\w+|\w+ing\b|\w+\s+of\s+the\b)[^.?!]{0,160},\s*and\s+(then\s+)?(to\s+\w+|that\s+\w+|\w+ing\b|it\s|\w+\s+must\b)"),
        ],
    ),
    (
        "wordy-phrase-2",
        [
            ("a number of", r"\b(a number of|there remains? )\b"),
            ("the present study", r"\bthe present (study|paper|report|work)\b"),
            ("seeks to investigate", r"\b(seeks?|aims?) to (investigate|examine|explore|determine|assess)\b"),
            ("would seem to", r"\bwould (seem|appear) to\b"),
            ("results obtained from", r"\b(results|data|findings) obtained\b"),
            ("methodology employed", r"\b(methodology|method|approach) (employed|utilised|utilized)\b"),
            ("enable us to", r"\benable(s|d)? (us|you|them|me) to\b"),
            ("circle back / touch base", r"\b(circle back|touch base|reach out)\b"),
            ("do not hesitate to", r"\bdo not hesitate to\b"),
            ("has not been VERBed", r"\b(has|have|had) not been \w+(ed|en|wn)\b"),
            (", having VERBed,", r",\s*having \w+(ed|en|wn)\b"),
            ("parenthetical (which ...)", r"\(\s*(which|that|who)\b"),
            ("chained modal pronoun", r"\b(we|they|i|it) (could|can|should|would|will) \w+[^.?!]{0,160}\b(or|and)\s+(we|they|i|it)\s+(could|can|should|would|will)\b"),
        ],
    ),
    (
        "parallelism-2",
        [
            ("gerund list + and to VERB", r"\b\w{1,40}ing\b[^.?!]{0,160},\s*and\s+to\s+\w+"),
            ("wh-clause inside list", r",\s*(what|how|who|when)\s+\w+[^,]{0,160},\s*and\b"),
        ],
    ),
    (
        "question-bloat",
        [
            ("would it be possible for you", r"\bwould it be possible for (you|us|me)\b"),
            ("do you happen to know", r"\bdo you happen to know\b"),
            ("let me know what X is", r"\blet me know what\b[^.?!]{0,160}\bis\?"),
            ("do not forget to", r"\bdo not forget to\b"),
            ("provide us with", r"\bprovide (us|me|them|you) with\b"),
            ("wanted to reach out", r"\bwanted to reach out\b"),
            ("just to give", r"^just to\b"),
            ("the question of who/what", r"\bthe question of (who|what|whether|how)\b"),
        ],
    ),
]

# Determiners.
DETERMINER = r"(?:the|a|an|this|that|these|those|our|your|their|his|her|its|my)"

# Phrase rules (phrase, replacement, lookahead), in application order.
RULES: list[tuple[str, str, str]] = [
    ("due to the fact that", "because", r""),
    ("in spite of the fact that", "although", r""),
    ("at this point in time", "now", r""),
    ("in order to", "to", r""),
    ("in order for", "for", r""),
    ("has the ability to", "can", r""),
    ("have the ability to", "can", r""),
    ("for the purpose of", "for", r""),
    ("in the near future", "soon", r"(?!\s+of\b)"),
    ("revert back", "revert", r""),
    ("based off of", "based on", r""),
    ("very unique", "unique", r""),
    ("completely identical", "identical", r""),
    ("absolutely essential", "essential", r""),
    ("a large number of", "many", r""),
    ("the majority of", "most", r""),
    ("on account of the fact that", "because", r""),
    ("in light of the fact that", "because", r""),
    ("with the exception of", "except for", r""),
    ("in the vicinity of", "near", r""),
    ("for a period of", "for", r"(?!\s+time\b)"),
    ("makes mention of", "mentions", r""),
    ("make mention of", "mention", r""),
    ("made mention of", "mentioned", r""),
    ("gives approval to", "approves", r"(?=\s+(?:the|a|an|this|that|these|those|our|your|their|his|her|its|my)\b)"),
    ("give approval to", "approve", r"(?=\s+(?:the|a|an|this|that|these|those|our|your|their|his|her|its|my)\b)"),
    ("gave approval to", "approved", r"(?=\s+(?:the|a|an|this|that|these|those|our|your|their|his|her|its|my)\b)"),
    ("gives consideration to", "considers", r""),
    ("give consideration to", "consider", r""),
    ("gave consideration to", "considered", r""),
    ("makes use of", "uses", r""),
    ("make use of", "use", r""),
    ("made use of", "used", r""),
    ("provides a description of", "describes", r""),
    ("provide a description of", "describe", r""),
    ("provided a description of", "described", r""),
    ("carries out a review of", "reviews", r""),
    ("carry out a review of", "review", r""),
    ("carried out a review of", "reviewed", r""),
    ("puts forward a proposal for", "proposes", r""),
    ("is able to", "can", r""),
    ("are able to", "can", r""),
    ("has the capability to", "can", r""),
    ("have the capability to", "can", r""),
    ("prior to", "before", r""),
    ("in close proximity to", "near", r""),
    ("each and every", "every", r""),
    ("as to whether", "whether", r""),
    ("all in all", "overall", r""),
    ("at the present moment", "now", r"(?!\s+of\b)"),
    ("at the present time", "now", r"(?!\s+of\b)"),
    ("during the course of", "during", r"(?=\s+(?:the|a|an|this|that|these|those|our|your|their|his|her|its|my)\b)"),
    ("on a daily basis", "daily", r""),
    ("on a weekly basis", "weekly", r""),
    ("on a monthly basis", "monthly", r""),
    ("on a quarterly basis", "quarterly", r""),
    ("on a yearly basis", "yearly", r""),
    ("on an annual basis", "annually", r""),
    ("on a regular basis", "regularly", r""),
    ("is in the process of", "is", r"(?=\s+\w+ing\b)"),
    ("are in the process of", "are", r"(?=\s+\w+ing\b)"),
    ("was in the process of", "was", r"(?=\s+\w+ing\b)"),
    ("were in the process of", "were", r"(?=\s+\w+ing\b)"),
    ("conducts an investigation into", "investigates", r""),
    ("conduct an investigation into", "investigate", r""),
    ("conducted an investigation into", "investigated", r""),
    ("makes an assessment of", "assesses", r""),
    ("make an assessment of", "assess", r""),
    ("made an assessment of", "assessed", r""),
    ("undertakes a comparison of", "compares", r""),
    ("undertake a comparison of", "compare", r""),
    ("undertook a comparison of", "compared", r""),
    ("performs the validation of", "validates", r""),
    ("perform the validation of", "validate", r""),
    ("performed the validation of", "validated", r""),
    ("results in the reduction of", "reduces", r""),
    ("result in the reduction of", "reduce", r""),
    ("resulted in the reduction of", "reduced", r""),
]

# Sentence-opening frames that are dropped, and the words that may follow them.
OPENERS = ["it should be noted that", "it is worth noting that", "it is important to note that", "it is worth mentioning that", "it must be noted that", "please note that"]
OPENER_FOLLOWERS = "(?:the|a|an|this|these|those|that|our|your|their|his|her|its|my|we|i|it|they|he|she|you|there|no|every|each|all|some|most|many|one)"

# Reasons of rules that are not told by their length, and how the reason of a dropped frame ends.
RULE_REASONS = {
    "revert back": "To revert is already to go back.",
    "based off of": "The usual form is “based on”.",
    "very unique": "Unique is not a matter of degree.",
    "completely identical": "Identical is already complete.",
    "absolutely essential": "Essential is already absolute.",
}
FRAME_REASON = "” delays the point without adding to it."

# What may not stand before "in order to/for" and "with the exception of".
IN_ORDER_BLOCK = r"(?:\b(?:is|are|was|were|am|be|been|being|seem|seems|seemed|look|looks|looked|appear|appears|appeared|remain|remains|remained)\s{1,4})|(?:\b(?:put|puts|putting|keep|keeps|keeping|set|sets|setting|get|gets|getting|got)\b[^,.;:]{0,200})"
EXCEPTION_BLOCK = r"\b(?:deal|deals|dealt|dealing|cope|copes|coped|coping|end|ends|ended|ending|start|starts|started|starting|begin|begins|began|beginning)\s{1,4}"

# Abbreviations whose dot ends no sentence.
ABBREVIATIONS = """
mr mrs ms dr prof sr jr st mt rev hon inc ltd co corp dept est fig no vol ed eds al etc vs approx min max ca cf ibid op
jan feb mar apr jun jul aug sep sept oct nov dec mon tue tues wed thu thur thurs fri sat sun a.m p.m e.g i.e u.s u.k ph.d d.c
""".split()

# Word groups of the meaning guards.
CERTAINTY = [
    "may might could perhaps possibly possible possibility chance risk likely unlikely probably probable apparently seems seem appears appear tendency tend tends arguably presumably supposedly reportedly allegedly conceivably ostensibly".split(),
    "generally typically basically essentially roughly mostly largely broadly fairly somewhat relatively".split(),
    "must shall required requires require requirement need needs needed necessary necessity mandatory obligation obliged".split(),
    "should ought recommend recommends recommended recommendation advise advises advised advice suggest suggests suggested suggestion".split(),
    "will would promise promises promised commit commits committed commitment guarantee guarantees guaranteed".split(),
    "can cannot able ability unable capable capability".split(),
    "nearly almost virtually practically".split(),
]
QUANTIFIERS = [
    "all every each any both either neither none no".split(),
    "some several many few most much number lot lots plenty majority".split(),
    "only just solely exclusively merely".split(),
    "exactly approximately about around roughly least most".split(),
    "always never sometimes often rarely usually".split(),
]
PERIPHRASTIC = "number lot lots plenty majority".split()
VAGUE = "some several many few most much".split()
QUANTITY = r"(?:[$€£¥₹]\s?\d[\d.,]*|\d[\d.,]*|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|fifteen|twenty|thirty|forty|fifty|sixty|hundred|thousand|million|billion|half|dozen)"
BOUNDS = ["no more than", "no fewer than", "no less than", "more than", "fewer than", "less than", "up to"]
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth".split()
PRONOUNS = [
    "i me my mine myself".split(),
    "we us our ours ourselves".split(),
    "you your yours yourself yourselves".split(),
    "he him his himself".split(),
    "she her hers herself".split(),
    "they them their theirs themselves".split(),
    "it its itself".split(),
]
CONNECTIVES = ["although but despite however though whereas yet nevertheless".split(), "if unless".split(), "because since therefore so thus".split()]
DIRECTIONS = [["before", "after", "when", "while", "once"], ["and", "or"], ["until", "since"], ["on", "off"], ["up", "down"], ["above", "below"], ["over", "under"], ["more", "less"]]
FAILURES = "fail fails failed failing failure failures".split()
SCOPE = ["unless", "until", "except", "only", "own"]
NEGATION = r"\b(?:no\s+one|nobody|nothing|nowhere|no|not|never|neither|nor|without|cannot|none)\b|n['’]t\b"
NEGATIONS = "nobody nothing nowhere no not never neither nor without cannot none".split()
NOT_AS_SPELLING = [r"\bwhether\s+or\s+not\b", r"\b(?:do|does|did|to)?\s*not\s+(?:forget|forgets|forgot|neglect|neglects|neglected|omit|omits|omitted|hesitate|hesitates|hesitated)\s+to\b"]
CONFUSABLES = "affect:effect affects:effects affected:effected then:than its:it's your:you're their:there there:they're lead:led to:too loose:lose principal:principle complement:compliment ensure:insure accept:except advice:advise farther:further".split()
FUNCTION_WORDS = """
a an the and or nor but so yet for of to in on at by with from into onto over under above below between through during before after
since until while about against among across behind beside beyond within without upon per is are was were be been being am has have
had having do does did done doing will would shall should can could may might must i you he she it we they me him her us them my your
his its our their this that these those who whom whose which what when where why how there here not no if then than as such very too
also just only each every all any some both either neither one more most less least other another same own up down out off
""".split()

# Patterns of numbers and of tokens that a rewrite must keep as written.
NUMBER = r"(?:(?<![\p{L}\p{N}])[-−](?:[$€£¥₹]\s?)?)?\b\d+(?:[.,:]\d+(?=(?:st|nd|rd|th)?\b))*+(?:st|nd|rd|th)?\b%?"
PROTECTED = [
    r"[$€£¥₹]\s?\d[\d.,]*",
    r"\d[\d.,]{0,80}\s?[$€£¥₹]",
    r"(?i)https?://[^\s<>{}\[\]]+",
    r"\b[\w.+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){0,15}\.[A-Za-z]{2,24}\b",
    r"(?<![\w.@+:/-])(?:/[\w.@+-]+)++",
    r"\b[A-Za-z]:\\[^\s\\]+(?:\\[^\s\\]+)*+",
    r"(?i)\b[\w-]{1,255}\.(?:csv|json|log|md|txt|ya?ml|pdf|js|py|sql|xml|html)\b",
    r"\b(?:[A-Z]{2,}[A-Z0-9_-]*|[A-Za-z]+_[A-Za-z0-9_]+)\b",
    r"\b[A-Za-z]+\d+[A-Za-z0-9]*\b",
    r"\b\d{1,2}:\d{2}\b",
    r"\[\d+\]",
    r"(?i)\b\d+(?:[.,]\d+)?\s*(?:(?:ms|s|min|h|hz|khz|mhz|ghz|kb|mb|gb|tb|kib|mib|gib|mm|cm|m|km|kg|g|v|w|kw|volts?|°c|°f|utc)\b|%)",
]
INSTRUCTION_OUTPUT = r"(?i)^(?:certainly|okay|sure|here(?:'s| is)|rewritten|revised|improved|suggestion|output)\b[^:]{0,40}:"
# Reasons a rewrite is refused for.
REASONS = """
action-mismatch empty unchanged instruction-output multiple-sentences numbers-changed protected-token-changed markup-changed name-changed
certainty-changed quantifier-changed content-dropped negation-changed tense-changed question-changed terminal-punctuation-changed
word-substituted reason-contradicts-action trivial-edit excessive-edit pronoun-changed direction-changed order-changed information-dropped
""".split()

# Narrow senses of quantifiers and of words of direction.
SOFT_JUST = r"^\s*just\b(?=\s+(?:to\s+\p{L}|\p{L}+ing\b))|\bjust\b(?=\s+like\s+to\b)"
NARROW_NO = r"\bno\b(?!\s+longer\b)"
NARROW_ONCE = r"(?<!\b(?:at|just|only|every|for)\s)\bonce\b(?!\s+(?:a|an|per|every|more|again|or\s+twice)\b)"
NARROW_WHILE = r"(?<!\b(?:a|the|short|long|little|good)\s)\bwhile\b"
PHRASAL_HOSTS = "base|based|basing|sign|signs|signed|signing|log|logs|logged|logging"

# Softening and stacked hedges, taken out before certainty is counted.
SOFT_WOULD = r"\bwould\b(?=\s+(?:just\s+)?(?:like|love|prefer|say|argue|appreciate)\b|\s+it\s+be\b|\s+you\s+(?:please|mind|be)\b)"
EVIDENTIAL = r"\b(?:(?:would|could|might|may)\s+)?(?:seems?|appears?)\s+to\s+(?=(?:suggests?|indicates?|imply|implies|shows?|points?)\b)"
#: Certainty groups whose members hedge the claim itself.
EPISTEMIC = (0, 3)

# Replies that are no rewrite, and frames that only direct attention.
KEEP_REASON = r"\b(?:already (?:clear|correct|concise|direct)|is clear and (?:direct|correct)|no (?:change|issue|problem)s? (?:is |are )?(?:needed|found))\b"
REFUSAL = r"^\s*(?:i(?:'m| am)? ?(?:'m)? ?sorry\b|sorry[,.]|i (?:will not|won'?t|cannot|can'?t|do not|don'?t|am unable to|am not able to)\b|as an ai\b|unfortunately[,.]? i\b)|\b(?:violates?|against|contrary to) (?:my|our|the) (?:guidelines?|policy|policies|rules?|content policy)\b|\bi (?:cannot|can'?t|will not|won'?t) (?:help|assist|comply|do that|provide)\b"
ATTENTION = r"^(?:it should be noted that|it is worth noting that|it is worth mentioning that|it is important to note that|it must be noted that|it bears mentioning that|please note that)\s+"

# Auxiliaries with "n't" whose longhand is not the stem alone.
CONTRACTED = {"won't": "will not", "can't": "can not", "cannot": "can not", "shan't": "shall not", "ain't": "is not"}
CONTRACTED_STEMS = "do does did is are was were has have had could should would must might need".split()
# Contractions that only spell a pronoun and an auxiliary in one.
RESPELLED = {
    "it's": "it is", "that's": "that is", "there's": "there is", "here's": "here is", "he's": "he is", "she's": "she is", "what's": "what is", "who's": "who is", "let's": "let us", "i'm": "i am",
    "you're": "you are", "we're": "we are", "they're": "they are", "i've": "i have", "you've": "you have", "we've": "we have", "they've": "they have",
    "i'll": "i will", "you'll": "you will", "he'll": "he will", "she'll": "she will", "we'll": "we will", "they'll": "they will", "it'll": "it will",
    "i'd": "i would", "you'd": "you would", "he'd": "he would", "she'd": "she would", "we'd": "we would", "they'd": "they would",
}

# Markup that a rewrite must keep, first alternative first.
MARKUP = "|".join([
    r"`[^`\n]*`", r"\$\$[^$\n]+\$\$", r"(?<!\d)\$(?![\s\d$])[^$\n]*?(?<!\s)\$", r"(?<!\d)\$\d[^\s$\n]*\$", r"\|", r"!?\[\[[^\]\n]{0,1000}\]\]", r"!?\[[^\]\n]{0,1000}\]\([^)\n]{0,1000}\)",
    r"^\s{0,3}#{1,6}(?=\s)", r"^\s{0,3}(?:[-*+]|\d+[.)])(?=\s)", r"^\s{0,3}>+(?=\s|$)",
    r"(?<!\s)(?:\*{1,2}|~~|==)|(?:\*{1,2}|~~|==)(?!\s)", r"(?<![\p{L}\p{N}])_{1,2}|_{1,2}(?![\p{L}\p{N}])",
])

# Words that may open a sentence with a capital and are no names, beside function words and the word groups above.
OPENING_ADVERBS = """
accordingly additionally admittedly apparently arguably basically briefly broadly certainly clearly consequently conversely effectively
essentially evidently fortunately frankly frequently furthermore historically honestly hopefully ideally importantly interestingly naturally
nevertheless nonetheless normally notably obviously occasionally ordinarily particularly presumably rarely realistically roughly strictly
surely technically ultimately undoubtedly
""".split()
OPENING_WORDS = """
according again almost along already although always anyone around avoid based because become besides cannot check collect come compared
concerning consider consult contact create currently data despite due earlier else engineers enough even eventually ever everyone everything
except expect few finally first following further fewer generally give given go half help hers high however include including initially inside
instead keep last later leave let like likely little long look make many maybe meanwhile moreover much near nearly need never new next none
note nothing notice now often once open originally others otherwise ours outside overall owing past perhaps please plus possibly practically
previously prior probably provide put read recently regarding remember remove results review run see send several short similarly someone
something sometimes soon specifically start still stop subsequently sure take team teams thanks theirs therefore though throughout thus today
together tomorrow toward towards try typically unfortunately unless us use used users using usually via virtually well whenever whether yes
yesterday yet yours
""".split()
NUMBER_WORDS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty
forty fifty sixty seventy eighty ninety hundred thousand million billion trillion half dozen first second third fourth fifth sixth seventh
eighth ninth tenth
""".split()

# Forms of verbs for the reading of tense.
PAST_IRREGULAR = """
became began broke brought built came chose did drew drove fell felt found gave grew had held kept knew led left lost made met paid ran read
said saw sent set spoke stood took told was went were won wrote
""".split()
IRREGULAR_ENDINGS = """
took went came gave saw made said paid held led ran stood wrote drew knew grew threw brought bought caught taught thought found built sent
spent lost left felt kept
""".split()
VERB_PREFIXES = "un re over under with fore mis out up".split()
PAST_PARTICIPLES = """
gone taken written known seen done been begun given chosen spoken broken driven eaten fallen forgotten hidden ridden risen shaken stolen thrown
worn torn flown grown drawn blown shown sung held kept met run come become left lost sent built
""".split()
NOT_PAST_ED = "need needs indeed seed feed speed deed creed breed greed exceed proceed succeed embed shed sled bed red wed".split()
AUXILIARIES = "was were is are am did do does has have had".split()
PRESENT_BE = "am are is be been being".split()
PERFECT = "has have had".split()
PAST_EVIDENCE = r"\b(?:yesterday|ago|last\s+(?:night|week|month|year|quarter|friday|monday|tuesday|wednesday|thursday|saturday|sunday))\b"
INVARIANT_PAST = "put set cut hit let cost hurt shut split spread cast burst read bet quit bid thrust upset broadcast forecast".split()
INTENSIFIERS = """
very completely totally absolutely entirely utterly really quite extremely highly fully truly simply wholly altogether thoroughly together
definitely certainly particularly especially rather somewhat
""".split()

# Times and the prepositions that set them as a limit.
DEADLINE_PREPOSITIONS = "before by after until till from on".split()
TIMES = """
noon midnight midday dawn dusk today tomorrow yesterday monday tuesday wednesday thursday friday saturday sunday january february march april may
june july august september october november december
""".split()

# Words for the guards of order and roles.
SUBORDINATORS = "if unless because since while although though when after before as".split()
ADJUNCT_PREPOSITIONS = "in on at within inside during under beneath behind beside near throughout".split()
NOUN_DETERMINERS = "the a an this that these those its their his her our my your each every any some".split()
PASSIVE = (
    r"\b(?:am|is|are|was|were|be|been|being)\s+(?:\w+ly\s+)?(?:\w+(?:ed|en|wn|ne|lt|ung|eld|ade|aid|ept|ent|old|uilt|ead|one))\s+by\s+"
    r"(?!(?:noon|midnight|midday|dawn|dusk|dark|then|now|today|tomorrow|yesterday|monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|may|june|july|august|september|october|november|december|next|early|late|end|the\s+end|\d)\b"
    r"|(?:a|an|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|several|many|\d+)\s+(?:seconds?|minutes?|hours?|days?|weeks?|months?|quarters?|years?)\b)"
)
EXPLETIVE_PASSIVE = r"^\s*it\s+(?:\w+\s+){1,3}by\b[^.]*\bthat\b"
BE_FORMS = "be been being is are was were am".split()

# What tells forms of one word.
SUFFIXES = "ation ison sion tion ance ence ment ing ion ed es al s e".split()
LEMMAS = [
    "meet meets meeting meetings met", "go goes going went gone", "take takes taking took taken", "write writes writing wrote written", "see sees seeing saw seen",
    "agree agrees agreed agreeing agreement agreements", "hold holds holding held", "give gives giving gave given", "speak speaks speaking spoke spoken",
    "choose chooses choosing chose chosen choice choices", "begin begins beginning began begun", "send sends sending sent", "build builds building built",
    "buy buys buying bought", "bring brings bringing brought", "think thinks thinking thought thoughts", "lose loses losing lost loss losses",
    "find finds finding found", "know knows knowing knew known knowledge", "pay pays paying paid payment payments",
]
INFLECTIONS = "s es ed d ing ly er ers est or ors ion ions ment ments ance ence ally ness".split()
DERIVATIONS = "ion ions ment ments ance ence ness ing al ure ity er ers or ors".split()
NOMINAL_TAIL = "(?:ion|ment|ance|ence|ure|ity|al)$"
NUMBER_NEUTRAL = "the my our your his her its their no any some".split()
TOPIC_PREPOSITIONS = "regarding concerning about on".split()
RULING_VERBS = "determine determines determined decide decides decided rule rules ruled settle settles settled judge judges judged resolve resolves resolved".split()
REDUCTIONS = """
soon later now today daily weekly monthly quarterly yearly annually near nearby because although though whether if unless while since after before
during tends tend ensure ensures can cannot must may might should will would believes believe believed thinks think expects expect
""".split()

# Deletions that cost the reader nothing, and those that always do.
STOCK_NOUNS = "point time basis proximity receipt order regard respect fact event purpose means terms nature".split()
REDUNDANT = """
brand end exactly ahead back again future past added mutual advance basic unexpected final close joined free personal true actual general
overall total sum new own different various separate individual current still
""".split()
REPETITION = "^(?:repeat(?:s|ed|edly|ing)?|repetition|return(?:s|ed|ing)?|revert(?:s|ed|ing)?|resend|resent|resubmit(?:s|ted|ting)?|restart(?:s|ed|ing)?|reissue[ds]?|retry|retries|retried|recur(?:s|red|ring)?|twice|still|re)$"
CARRIERS: dict[str, str] = {
    "because": "fact account reason due owing light",
    "although": "spite fact",
    "though": "spite fact",
    "soon": "near future shortly",
    "now": "present moment current currently time point",
    "later": "subsequent subsequently stage point time",
    "today": "day",
    "daily": "day days basis",
    "weekly": "week weeks basis",
    "monthly": "month months basis",
    "quarterly": "quarter quarters basis",
    "yearly": "year years basis",
    "annually": "year years basis",
    "near": "close proximity vicinity located situated positioned",
    "nearby": "close proximity vicinity located situated positioned",
    "can": "able ability capability capacity",
    "cannot": "unable inability ability capability capacity",
    "must": "necessary necessity mandatory obliged obligation",
    "may": "possible possibility chance perhaps likely",
    "might": "possible possibility chance perhaps likely",
    "should": "recommended recommendation advisable advised",
    "will": "going committed commitment",
    "would": "going",
    "tends": "tendency",
    "tend": "tendency",
    "if": "event case condition",
    "unless": "event case condition",
    "whether": "question",
    "ensure": "sure certain make makes made",
    "ensures": "sure certain make makes made",
    "before": "prior advance ahead",
    "after": "subsequent subsequently following",
    "during": "course duration middle midst",
    "while": "time period",
    "since": "time point",
    "believes": "opinion view belief impression",
    "believe": "opinion view belief impression",
    "believed": "opinion view belief impression",
    "thinks": "opinion view belief impression",
    "think": "opinion view belief impression",
    "expects": "expectation expectations anticipation",
    "expect": "expectation expectations anticipation",
    "several": "number lot lots plenty amount quantity majority",
    "many": "number lot lots plenty amount quantity majority",
    "most": "number lot lots plenty amount quantity majority",
    "much": "number lot lots plenty amount quantity majority",
    "some": "number lot lots plenty amount quantity",
    "few": "number lot lots plenty amount quantity minority",
    "about": "regard regards regarding concerning respect terms relation reference",
    "this": "present current",
}
LIGHT_VERBS = """
make makes made take takes took give gives gave put puts perform performs performed conduct conducts conducted carry carries carried undertake
undertakes undertook provide provides provided hold holds held reach reaches reached
""".split()
LIGHT_PARTICLES = "forward out into".split()
PRO_FORMS = "one ones it them this that these those some".split()
FILLERS = r"\bin\s+place\b(?!\s+of)|\bin\s+the\s+process\s+of\b|\bat\s+the\s+present\s+(?:time|moment)\b|\bin\s+question\b|\bat\s+hand\b|\bin\s+nature\b|\bas\s+such\b|\bwould\s+(?:just\s+)?(?:like|love)\s+to\b|\bdo\s+not\s+hesitate\s+to\b|\bplease\s+feel\s+free\s+to\b"
FIXED_PAIRS = r"\b(?:first\s+and\s+foremost|null\s+and\s+void|each\s+and\s+every|one\s+and\s+only|aches\s+and\s+pains|law\s+and\s+order)\b"
NEVER_VERIFY = "twice once thrice repeatedly rarely frequently again".split()

# Spans that no repair may reach into, and names of days and months.
UNTOUCHABLE = "|".join([
    r"(?i:https?://\S+)", r"\b[\w.+-]{1,64}@[\w.-]{1,255}\.[A-Za-z]{2,24}\S*", r"(?<![\w~/])~?(?:/[^\s/]+)++/?", r"\b[A-Za-z]:\\\S+",
    r"(?i:\b[\w-]{1,255}\.(?:csv|json|log|md|txt|ya?ml|pdf|js|py|sql|xml|html)\S*)", r"`[^`\n]*`",
    r"\$\$[^$\n]+\$\$|(?<!\d)\$(?![\s\d$])[^$\n]*?(?<!\s)\$|(?<!\d)\$\d[^\s$\n]*\$", r"!?\[\[[^\]\n]{0,1000}\]\]", r"!?\[[^\]\n]{0,1000}\]\([^)\n]{0,1000}\)",
])
DAYS_AND_MONTHS = "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split()
MONTH_OR_WORD = "may march august".split()

# Addresses in files, and what may stand before one that is asked for and not only named.
ABSOLUTE_ADDRESS = r"https?://[^\s\"'`)<>\]}\\]+"
RELATIVE_ADDRESS = r"(?:\b(?:src|href|action|formaction|poster|data|srcset|imagesrcset|xlink:href)\s*=\s*[\"']?|url\(\s*[\"']?|@import\s+[\"'])//"
REQUEST_PLACES = [
    (r"(?:\bsrc|\bhref|\baction|\bformaction|\bposter|\bsrcset|\bimagesrcset|xlink:href)\s*=\s*[\"']?$", "a src/href attribute"),
    (r"url\(\s*[\"']?$", "a CSS url()"),
    (r"@import\s+[\"']?$", "a CSS @import"),
    (r"(?:fetch|importScripts|sendBeacon|open|connect)\s*\(\s*[\"'`]$", "a fetch or request call"),
    (r"new\s+(?:URL|WebSocket|EventSource|Worker|Request)\s*\(\s*[\"'`]$", "a URL, socket or worker constructor"),
    (r"import\s*\(\s*[\"'`]$", "a dynamic import"),
]
MENTIONED, NO_SCHEME, INHERITS = "a literal in the built file", "(protocol-relative)", "a protocol-relative reference, which inherits https:// when served"

# Words that explanations of an edit tell apart.
ARTICLES = "a an the".split()
AGREEMENT = "is are was were has have had does do did needs need requires require works work sign signs".split()

# What makes a claim-shaped clause no claim.
CLAIM_GUARDS = {
    "denied": r"\b(?:not|never|neither|nor|nobody|none|cannot|can't|without|un(?:measured|tested|verified|timed)|dropped|abandoned|rather than|instead of|yet to)\b",
    "planned": r"\b(?:if|unless|until|would|should|shall|plan|planned|planning|goal|goals|target|criterion|criteria|proposed|intend|intends|aim|aims|re-?measure|go\/no-go)\b",
    "sourced": r"(?:`[^`]*\.(?:mjs|json|md|txt|yml|yaml|js|gguf)`|\bbench\/|\btests?\/|\bREPORT\.md\b|\bROADMAP\.md\b|\bcorpus\b|\bcorpora\b|\bholdout\b|\bbattery\b|\boracle\b|\bprecision-check\b|\bunlock-check\b|\bMB\/s\b|\bMbps\b|\bXeon\b|\bdatacentre\b|\bdatacenter\b|\b\d+\s*\/\s*\d+\b|\b\d[\d,.]{0,40}\s+(?:of|accepted|recorded|refusals|sentences|rows|tests)\b)",
    "names_the_model": r"\b(?:Qwen[\w.-]*|llama\.cpp|llama-server|GGUF|Ollama|Q6_K|Q4_K_M)\b",
}
# Claims as (rule, pattern, what must stand in the same clause, guards that excuse it).
CLAIMS = [
    ("marketing/boast", r"\b(?:revolutionary|game[-\s]?chang(?:ing|er)|seamless(?:ly)?|blazing(?:ly)?|cutting[-\s]edge|state[-\s]of[-\s]the[-\s]art|world[-\s]class|effortless(?:ly)?|magical(?:ly)?|unleash(?:es|ed|ing)?|supercharge(?:s|d|ing)?)\b", None, []),
    ("marketing/multiplier", r"\b10\s?-?\s?x\b", None, []),
    ("marketing/ai-powered", r"\bAI[-\s]powered\b", None, ["names_the_model"]),
    ("marketing/exclamation", r"!(?![=\[])", None, []),
    ("absolute/never-wrong", r"\b(?:never wrong|always right|always correct|100\s*%\s*(?:accurate|correct|precise|safe|reliable)|always preserves|never changes your meaning|cannot change your meaning|can't change your meaning|will not change your meaning)\b", None, []),
    ("absolute/perfection", r"\bflawless\b|\binfallible\b|(?<!\b(?:past|present|future|to)\s)\bperfect\b(?!\s+(?:aspect|tense|participle))", None, []),
    ("absolute/guarantee", r"(?<!\b(?:no|not|never|without)\s)(?:\bguarantees\b|\bguaranteed\b|\bguarantee(?=\s+(?:that|to)\b))", None, ["sourced"]),
    ("absolute/false-positives", r"\b(?:zero|no|0)\s+false\s+(?:positives|negatives)\b", None, ["sourced"]),
    ("unsupported/install-time", r"\b(?:installs?|installed|installing|installation|set[-\s]?up|setup|provisions?|provisioned|provisioning|up and running)\b", r"\b(?:\d+(?:[.,]\d+)?|one|two|three|four|five|six|seven|eight|nine|ten|fifteen|twenty|thirty)[\s-]*(?:seconds?|secs?|s|minutes?|mins?|hours?)\b", ["denied", "planned", "sourced"]),
    ("unsupported/register-search", r"\b(?:USPTO|TESS|TSDR|trademark register|trademark database|register of trade\s?marks)\b", r"\b(?:search(?:ed|es|ing)?|check(?:ed|s)?|clear(?:ed|ance)|screen(?:ed)?|looked up|query|queried)\b", ["denied", "planned"]),
    ("unsupported/platform-performance", r"\b(?:apple[-\s]silicon|metal|windows|(?:2|two)[-\s]core)\b", r"\b(?:p50|p95|latency|milliseconds?|ms|tokens\/s|tok\/s|throughput|faster|fastest|speedup|benchmarked|measured|timed|runs at)\b", ["denied", "planned", "sourced"]),
]
# The comment that waives claims, and its body of rules and reason.
WAIVER = r"<!--\s*forbidden-phrases:\s*allow\b([\s\S]*?)-->"
WAIVER_BODY = r"^\s*([A-Za-z0-9/,\s-]+?)(?:\s*(?:—|–|--|:)\s*|\s+-\s+)(\S[\s\S]*)$"
