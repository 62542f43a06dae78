"""Problem 3: broken prompt and response pairs.

Method: ordered rules over each pair, all of them column expressions that stay
in the JVM: emptiness, copied questions, refusal phrases of six languages,
script or language mismatch, unclosed delimiters and abrupt endings. ``defects``
emits every type that is triggered, in rule order; ``first_defect`` keeps the
first. The scan is narrow; only ids and results are shuffled, to make one
record of rows with the same id.

Defined results: a null or blank answer is ``empty`` whatever the question; with
a null question only the rules on the answer alone apply; rows with one id are
one record, the one of the largest ``order`` value decides; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.once import once

ORDER = ["empty", "echo", "refusal", "wrong_language", "truncated"]

#: What stands for a missing answer.
PLACEHOLDERS = ["null", "none", "nil", "nan", "n/a", "n.a.", "na", "tbd", "tba", "todo", "undefined", "no answer", "not available", "empty", "unknown", "keine antwort", "sans réponse", "sin respuesta", "sem resposta", "なし", "該当なし", "未定", "回答なし"]

#: Frequent function words by language; words of several languages count for each.
FUNCTION_WORDS = {
    "en": "the of and to is that it was for on are with as be at by this have from or had not but what which when how why where who you your they we she he can could would should must does do did an a in before after than more most less only about between never under while if then until without there has been its our whether me say give list define name explain describe tell show compare any all no so such these those them their his her out up into over because whose every each other some one many",
    "de": "der die das und ist nicht von zu den mit sich des auf für dem ein eine einen einem einer auch als an nach wie im für man aber aus durch wenn nur war wird bei oder muss hat noch viele dass ob was warum wie welche wo zwischen ohne über unter vor denn weil mehr zuerst dann am zum zur sehr nenne wirkt ich kann mir leid es tut",
    "fr": "le la les de des du et est un une que qui dans en pour pas sur au aux ce se sont avec par plus ne il elle on à comme mais ou où dont être avant après sans sous quand lorsque si alors entre trop comment pourquoi quels quelles quel quelle puis tandis car doit cette ces son sa ses l d qu n c je ne peux dois",
    "es": "el la los las de del y es un una que en para por con no se su al lo como más pero o sobre entre sin cuando si entonces muy antes después hasta desde donde qué cómo cuál cuáles cuántos por porque hay debe mucha gente nadie estaba fue ser está toda luego primero me puedo",
    "pt": "o a os as de do da dos das e é um uma que em para por com não se seu sua ao no na nos nas como mais mas ou sobre entre sem quando então muito antes depois até desde onde qual quais quantos porque há deve muita gente ninguém estava foi ser está toda primeiro já eu posso",
}
#: How a question asks for an answer in a language.
ASKS_FOR = {
    "en": r"\b(?:in english|auf englisch|en anglais|en inglés|em inglês)\b|英語で",
    "de": r"\b(?:in german|auf deutsch|en allemand|en alemán|em alemão)\b|ドイツ語で",
    "fr": r"\b(?:in french|auf französisch|en français|en francés|em francês)\b|フランス語で",
    "es": r"\b(?:in spanish|auf spanisch|en espagnol|en español|em espanhol)\b|スペイン語で",
    "pt": r"\b(?:in portuguese|auf portugiesisch|en portugais|en portugués|em português)\b|ポルトガル語で",
    "ja": r"\b(?:in japanese|auf japanisch|en japonais|en japonés|em japonês)\b|日本語で",
}
#: Openings of a polite refusal, then what is refused.
POLITE_EN = r"(?:(?:i'?m sorry|i am sorry|sorry|apologies|my apologies|unfortunately|regrettably|i am afraid|i'?m afraid|thank you for asking|thanks for asking|as an? (?:ai|assistant|ai assistant|language model|ai language model))[,;:.]? ?(?:but |that )?)*"
REFUSALS = [
    POLITE_EN + r"(?:i(?: am|'m) (?:unable|not able|not allowed|not permitted) to|i (?:can't|cannot|can not|won't|will not|must|have to)(?: be able to)? (?:decline|answer|help|assist|comply|provide|respond|discuss|share|do that|fulfil)|(?:that|this) is (?:not something|outside what) i|answering (?:this|that) would|(?:this|that) (?:goes|would go) against my)",
    r"(?:.{0,25}(?:申し訳|恐れ入|残念)|.{0,30}アシスタント)?.{0,25}(?:お答え|回答|お手伝い|対応|お応え|提供|ご案内).{0,12}(?:できません|できかね|いたしかね|致しかね|しかねます|控え)|.{0,30}(?:お断り|差し控え)",
    r"(?:es tut mir (?:sehr )?leid|tut mir leid|leider|entschuldigung|als (?:ki|assistent)[^.]{0,20}|diese (?:frage|anfrage)|dazu|dabei|damit)[^.]{0,25}(?:kann|darf|muss|möchte) ich[^.]{0,40}(?:nicht|keine|ablehnen)",
    r"(?:je suis )?désolée?,? .{0,30}(?:peux|sort|impossible)|(?:en tant qu.{0,20},? )?je (?:ne peux pas|ne suis pas en mesure|dois refuser|regrette)|il m.est impossible|malheureusement,? je",
    r"lo siento.{0,10} no|(?:lamentablemente|desafortunadamente),? no|no (?:me está permitido|puedo (?:ayudar|responder|dar|contestar))|(?:como (?:asistente|ia),? )?debo rechazar",
    r"(?:desculpe|lamento|sinto muito).{0,10} (?:mas )?não|infelizmente,? não|não (?:posso|consigo|me é permitido) (?:ajudar|responder|fornecer|dar)|(?:como (?:assistente|ia),? )?(?:devo|tenho de) recusar",
]

#: Words a complete answer doesn't end with.
DANGLING = (
    "the a an of and to is was are were that which who in on at by for with as from or but if because than then so such while when until before after into about under over between without nor my your their its our this these those be been has have had can could will would should must may not only just very more most the you he she they we i it "
    "der die das und ist von zu den mit des auf für dem ein eine einen einem einer als an nach wie im aber aus durch wenn dass weil denn oder am zum zur sobald bevor ohne um "
    "le les de des du et est un une que qui dans en pour sur au aux avec par ou mais car si lorsque tandis sans sous puis afin dont "
    "el los las del y es una con por para se su al como pero cuando sin entre hasta desde porque muy lo "
    "os as do da dos das e é um uma em no na nos nas com mas sem ao até"
)

#: Unicode's White_Space property.
BLANKS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_CJK = r"[\x{3041}-\x{30FF}\x{4E00}-\x{9FFF}]"


def _strip(c: Column) -> Column:
    c = F.regexp_replace(c, r"[\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{00AD}]", "")
    return F.trim(c, F.lit(BLANKS))


def _plain(c: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: w != "")


def _counts(text: Column) -> Column:
    """For each language, how many of its function words a text holds."""
    lists = [sorted(set(v.split())) for v in FUNCTION_WORDS.values()]
    known = F.filter(F.array_distinct(_words(text)), lambda w: w.isin(*sorted({w for some in lists for w in some})))
    # The counts lie side by side in one number, 12 bits each.
    packed = F.aggregate(known, F.lit(0).cast("long"), lambda n, w: n + sum((F.when(w.isin(*some), F.lit(1 << 12 * k).cast("long")).otherwise(F.lit(0).cast("long")) for k, some in enumerate(lists)), F.lit(0).cast("long")))
    return F.transform(F.array(packed), lambda n: F.array(*[F.shiftright(n, 12 * k).bitwiseAND(F.lit(4095).cast("long")) for k in range(len(lists))]))[0]


def _within(a: Column | str, b: str, most: str) -> Column:
    """Whether two columns are at most ``most`` edits apart; lengths are compared first, and the distance stops at the bound."""
    return F.expr(f"abs(length({a}) - length({b})) <= {most} AND levenshtein({a}, {b}, {most}) >= 0")


def _language(text: Column, counts: Column) -> Column:
    """Language of a text by script and function words; null where they don't tell or two languages lead."""
    best = F.array_max(counts)
    alone = F.size(F.filter(counts, lambda c: c == best)) == 1
    some = text.rlike(_CJK)
    cjk, letters = F.regexp_count(text, F.lit(_CJK)), F.regexp_count(text, F.lit(r"\p{L}"))
    names = F.array(*[F.lit(k) for k in FUNCTION_WORDS])
    return F.when(some & (cjk >= 3) & (cjk * 5 >= letters), F.lit("ja")).when((best >= 2) & alone, F.element_at(names, F.array_position(counts, best).cast("int")))


def defects(df: DataFrame, question: str, answer: str) -> DataFrame:
    """``df`` with ``defects``: every triggered type, in the order of ``ORDER``."""
    q, a = F.col("_q"), F.col("_a")
    work = once(df, _q=_strip(F.col(question)), _a=_strip(F.col(answer)))
    # What may follow the last sentence: emoji, a time mark or a reference in brackets.
    decor = r"(?U)(?:\s|[\p{So}\x{1F3FB}-\x{1F3FF}\x{FE0F}\x{200D}]|[\[(](?:see |at |vgl\. |cf\. )?(?:\d{1,2}:\d\d(?::\d\d)?|\d+ ?s|\d{1,3})[\])])+$"
    work = once(work, _core=F.when(F.right(a, F.lit(1)).rlike(r"(?U)[\s\p{So}\x{1F3FB}-\x{1F3FF}\x{FE0F}\x{200D}\])]"), F.regexp_replace("_a", decor, "")).otherwise(a), _qn=_plain(q), _an=_plain(a))
    core, qn, an = F.col("_core"), F.col("_qn"), F.col("_an")

    bare = F.regexp_replace(F.lower(a), r"(?U)^[\s\p{P}\p{S}]+|[\s\p{P}\p{S}]+$", "")
    slash = F.regexp_replace(F.lower(a), r"(?U)^[\s(\[<{\"'*]+|[\s)\]>}\"'*.]+$", "")
    # No placeholder has more letters and digits.
    longest = max(map(len, PLACEHOLDERS))
    empty = F.col(answer).isNull() | a.rlike(r"(?U)^[\s\p{P}\p{S}]*$") | ((F.length(an) <= longest) & (bare.isin(*PLACEHOLDERS) | slash.isin(*PLACEHOLDERS)))

    # A question may carry a sentence that asks for a language; the rest of it is asked all the same.
    asked_any = "(?i)" + "|".join(ASKS_FOR.values())
    work = once(work, _empty=empty, _asks=F.coalesce(q.rlike(asked_any), F.lit(False)))
    asks = F.col("_asks")
    kept = F.array_join(F.filter(F.split(q, r"(?<=[.!?。！？])"), lambda x: ~x.rlike(asked_any)), " ")
    work = once(work, _tq=F.when(asks, kept).otherwise(q))
    # What a text leaves of an answer that holds it, all its copies taken out.
    left = lambda text: F.when((F.length(text) >= 8) & F.contains(an, text), F.replace(an, text, F.lit("")))
    work = once(work, _rest=F.coalesce(left(qn), F.when(asks, left(_plain(F.col("_tq"))))), _slack=F.greatest(F.lit(2), (F.length(qn) / 10).cast("int")), _head=F.expr("left(_an, length(_qn))"), _tail=F.expr("right(_an, length(_qn))"))
    empty, rest, slack = F.col("_empty"), F.col("_rest"), F.col("_slack")
    ql, al = F.length(qn), F.length(an)
    near = (ql >= 8) & (al >= ql - slack) & (al <= ql + 30)
    close = _within("_qn", "_an", "_slack") | _within("_qn", "_tail", "_slack") | ((al <= ql + 12) & _within("_qn", "_head", "_slack"))
    # Copying the rest of such a question is an echo too.
    part = (al >= 8) & (al < ql) & (al * 10 >= ql * 6) & F.contains(qn, an)
    echo = F.when(near, F.contains(an, qn) | close).otherwise(part & asks)
    # So is the question said again and again, however long that gets.
    again = (F.length(rest) <= slack) | _within("_qn", "_rest", "_slack")
    echo = F.coalesce(echo, F.lit(False)) | F.coalesce(again, F.lit(False))

    low = F.col("_low")
    refusal = low.rlike("^(?:" + "|".join(f"(?:{r})" for r in REFUSALS) + ")")

    prose = F.regexp_replace(core, r"(?s)```.*?(?:```|$)", " ")
    last_line = F.element_at(F.split(core, r"\n"), -1)
    work = once(work, _ta=prose, _low=F.regexp_replace(F.lower(core), "[’`]", "'"), _last=last_line, _words=_words(core))
    work = once(work, _nq=_counts(F.col("_tq")), _na=_counts(F.col("_ta")))
    work = once(work, _lq=_language(F.col("_tq"), F.col("_nq")), _la=_language(F.col("_ta"), F.col("_na")))
    lq, la = F.col("_lq"), F.col("_la")
    asked = F.lit(False)
    for k, rx in ASKS_FOR.items():
        asked = asked | ((la == k) & q.rlike("(?i)" + rx))
    wrong = F.coalesce(lq != la, F.lit(False)) & ~F.coalesce(asks & asked, F.lit(False))

    fences = F.regexp_count(a, F.lit("```"))
    last = F.col("_last")
    listed = last.rlike(r"(?U)^\s*(?:\d{1,3}[.)、．]|[-*•・])(?:\s|$)")
    item = F.regexp_replace(last, r"(?U)^\s*(?:\d{1,3}[.)、．]|[-*•・])\s*", "")
    words, end = F.col("_words"), F.right(core, F.lit(1))
    dangles = F.coalesce(F.try_element_at(words, F.lit(-1)).isin(*sorted(set(DANGLING.split()))), F.lit(False)) & end.rlike(r"\p{L}")
    open_end = end.isin(*",;:([{-–—/、・「『（") | (F.regexp_count(last, F.lit(r"[(（「『\[]")) > F.regexp_count(last, F.lit(r"[)）」』\]]")))
    closed = F.rtrim(core, F.lit(BLANKS + "\"'»”’)]）」』*_`"))
    stops = F.right(closed, F.lit(1)).isin(*".!?。！？") & ~core.endswith("...")
    cjk = F.when(core.rlike(_CJK), F.regexp_count(core, F.lit(_CJK))).otherwise(0)
    many = (F.size(F.filter(F.split(core, r"(?U)\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))) > 7) | (cjk >= 10)
    earlier = core.rlike(r"(?Us)[.!?](?:\s)|[。！？]")
    japanese_cut = (cjk >= 3) & end.isin(*"はがをにのとでへもやか")
    truncated = (
        F.when(fences % 2 == 1, True)
        .when(core.endswith("```"), False)
        .when(listed, (item == "") | dangles | open_end)
        .when(stops, False)
        .otherwise(open_end | dangles | many | earlier | japanese_cut)
    )
    truncated = F.coalesce(truncated, F.lit(False))

    flag = {"empty": empty, "echo": ~empty & echo, "refusal": ~empty & F.coalesce(refusal, F.lit(False)), "wrong_language": ~empty & wrong, "truncated": ~empty & truncated}
    hits = F.filter(F.array(*[F.when(flag[k], F.lit(k)) for k in ORDER]), lambda x: x.isNotNull())
    return once(work, defects=hits).select(*[c for c in df.columns if c != "defects"], "defects")


def by_id(df: DataFrame, key: str, question: str, answer: str, order: str) -> DataFrame:
    """``key, defects`` of the record of each id that has any defect."""
    flagged = defects(df.select(key, question, answer, order), question, answer)
    return flagged.groupBy(key).agg(F.max_by("defects", F.struct(F.col(order), F.col("defects"))).alias("defects")).filter(F.size("defects") > 0)


def first_defect(df: DataFrame, key: str, question: str, answer: str, order: str) -> DataFrame:
    """``key, defect``: the first triggered type of each record."""
    return by_id(df, key, question, answer, order).select(key, F.col("defects")[0].alias("defect"))
