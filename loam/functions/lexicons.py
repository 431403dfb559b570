"""Word lists by language. Fixed values, in matching order; a marker's phrases end in the space or comma they need."""

from __future__ import annotations

#: Language code and the other names it goes by.
LANGUAGES = {
    "en": ("eng", "english"), "de": ("deu", "german"), "fr": ("fra", "french"), "es": ("spa", "spanish"), "pt": ("por", "portuguese"),
    "it": ("ita", "italian"), "nl": ("nld", "dutch"), "ru": ("rus", "russian"), "zh": ("cmn", "chinese"), "ja": ("jpn", "japanese"),
    "ko": ("kor", "korean"), "ar": ("ara", "arabic"), "tr": ("tur", "turkish"), "pl": ("pol", "polish"),
}

#: Pronouns that a text may start with.
PRONOUNS = {
    "en": "it they he she we its their his her our",
    "de": "es sie er wir sein seine ihr ihre deren dessen",
    "fr": "il elle ils elles on nous son sa ses leur leurs",
    "es": "él ella ellos ellas su sus nosotros nosotras",
    "pt": "ele ela eles elas seu sua seus suas nós",
    "it": "esso essa essi esse egli lui lei loro noi suo sua",
    "nl": "het hij zij ze wij we hun haar zijn",
    "ru": "он она оно они его её их мы наш наша",
    "tr": "o onlar biz onun onların bizim",
    "pl": "on ona ono oni one my ich jej jego nasz nasza",
}

#: Demonstratives, each followed by a space in the text.
DEMONSTRATIVES = {
    "en": ("this", "that", "these", "those", "such", "the same", "the above", "the following"),
    "de": ("diese", "dieser", "dieses", "diesen", "diesem", "jene", "jener", "jenes", "jenen", "jenem", "solche", "solcher", "solches"),
    "fr": ("ce", "cet", "cette", "ces", "celui", "celle", "ceux", "celles"),
    "es": ("este", "esta", "estos", "estas", "ese", "esa", "esos", "esas", "aquel", "aquella", "aquellos", "aquellas", "dicho", "dicha", "dichos", "dichas"),
    "pt": ("este", "esta", "estes", "estas", "esse", "essa", "esses", "essas", "aquele", "aquela", "aqueles", "aquelas"),
    "it": ("questo", "questa", "questi", "queste", "quello", "quella", "quelli", "quelle", "tale", "tali"),
    "nl": ("dit", "dat", "deze", "die", "dergelijk", "dergelijke"),
    "ru": ("этот", "эта", "это", "эти", "тот", "та", "те", "такой", "такая", "такое", "такие", "данный", "данная", "данное", "данные"),
    "tr": ("bu", "şu", "o", "böyle", "öyle", "söz konusu"),
    "pl": ("ten", "ta", "to", "te", "ci", "tamten", "tamta", "tamto", "taki", "taka", "takie"),
}

#: Function words that start no entity.
STOPWORDS = {
    "en": "the a an in on at to of by for with from and or but is are was were not no",
    "de": "der die das ein eine und oder aber in an auf zu von mit für ist sind war nicht kein keine",
    "fr": "le la les un une des et ou mais dans sur de du au aux par pour avec est sont pas ne",
    "es": "el la los las un una unos unas y o pero en de del al por para con es son no",
    "pt": "o a os as um uma uns umas e ou mas em de do da dos das por para com é são não",
    "it": "il lo la i gli le un uno una e o ma in di da del della per con è sono non",
    "nl": "de het een en of maar in op van met voor door is zijn niet geen",
    "ru": "и или но в на с по для из к о от не это что как",
    "tr": "ve veya ama ile için bir bu da de",
    "pl": "i lub ale w na z do od dla nie to jest są",
}

#: How strongly a marker ties a block to the one before it.
STRENGTH = {"Continuation": 0.9, "Elaboration": 0.85, "Exemplification": 0.8, "Causation": 0.7, "Contrast": 0.4, "Conclusion": 0.2}

#: How a text may start where it leans on the text before it.
ORPHANS = (
    "it ", "it's ", "its ", "this ", "these ", "those ", "that ", "they ", "them ", "their ", "they're ", "he ", "he's ", "him ", "his ",
    "she ", "she's ", "her ", "we ", "we've ", "us ", "our ", "there ", "here ",
)

#: Discourse markers and the phrases that a text starts with, each with the comma or space it needs.
MARKERS_EN = {
    "Continuation": ("furthermore,", "furthermore ", "additionally,", "additionally ", "in addition,", "in addition ", "moreover,", "moreover ", "also,", "also ", "likewise,", "likewise ", "similarly,", "similarly "),
    "Contrast": ("on the other hand,", "on the other hand ", "in contrast,", "in contrast ", "on the contrary,", "conversely,", "nevertheless,", "nonetheless,", "however,", "however ", "although ", "though ", "but ", "yet "),
    "Causation": ("as a result,", "as a result ", "consequently,", "consequently ", "therefore,", "therefore ", "because ", "thus,", "thus ", "hence,", "hence "),
    "Exemplification": ("for instance,", "for instance ", "for example,", "for example ", "such as ", "e.g.,", "e.g. "),
    "Elaboration": ("in particular,", "in particular ", "specifically,", "specifically ", "more precisely,", "namely,", "namely ", "that is,", "i.e.,", "i.e. "),
    "Conclusion": ("in conclusion,", "in conclusion ", "in summary,", "in summary ", "to summarize,", "to conclude,", "overall,", "overall ", "finally,", "finally "),
}
MARKERS_DE = {
    "Continuation": ("darüber hinaus ", "außerdem ", "zusätzlich ", "zudem ", "ferner ", "ebenso ", "auch "),
    "Contrast": ("auf der anderen seite ", "im gegensatz dazu ", "im gegensatz ", "nichtsdestotrotz ", "dennoch ", "jedoch ", "allerdings ", "obwohl ", "aber ", "doch "),
    "Causation": ("infolgedessen ", "folglich ", "daher ", "deshalb ", "deswegen ", "weil ", "denn ", "somit "),
    "Exemplification": ("zum beispiel ", "beispielsweise ", "etwa ", "z.b. "),
    "Elaboration": ("insbesondere ", "genauer gesagt ", "konkret ", "nämlich ", "das heißt ", "d.h. "),
    "Conclusion": ("zusammenfassend ", "abschließend ", "insgesamt ", "schließlich "),
}
MARKERS_FR = {
    "Continuation": ("de plus,", "de plus ", "en outre,", "en outre ", "par ailleurs,", "également,", "également ", "aussi,", "aussi ", "de même,"),
    "Contrast": ("en revanche,", "en revanche ", "au contraire,", "néanmoins,", "néanmoins ", "toutefois,", "toutefois ", "cependant,", "cependant ", "pourtant,", "bien que ", "mais "),
    "Causation": ("par conséquent,", "en conséquence,", "c'est pourquoi ", "donc,", "donc ", "ainsi,", "ainsi ", "parce que ", "car "),
    "Exemplification": ("par exemple,", "par exemple ", "notamment,", "notamment "),
    "Elaboration": ("en particulier,", "en particulier ", "plus précisément,", "c'est-à-dire "),
    "Conclusion": ("en conclusion,", "en résumé,", "pour conclure,", "en somme,", "finalement,", "finalement ", "enfin,", "enfin "),
}
MARKERS_ES = {
    "Continuation": ("además,", "además ", "asimismo,", "asimismo ", "igualmente,", "también,", "también ", "del mismo modo,"),
    "Contrast": ("por el contrario,", "en contraste,", "no obstante,", "sin embargo,", "sin embargo ", "aunque ", "pero "),
    "Causation": ("en consecuencia,", "por consiguiente,", "por lo tanto,", "por lo tanto ", "por eso,", "por eso ", "porque "),
    "Exemplification": ("por ejemplo,", "por ejemplo "),
    "Elaboration": ("en particular,", "en particular ", "concretamente,", "es decir,", "es decir "),
    "Conclusion": ("en conclusión,", "en resumen,", "en suma,", "finalmente,", "finalmente ", "por último,"),
}
MARKERS_PT = {
    "Continuation": ("além disso,", "além disso ", "também,", "também ", "igualmente,"),
    "Contrast": ("no entanto,", "no entanto ", "contudo,", "porém,", "porém ", "todavia,", "embora ", "mas "),
    "Causation": ("por conseguinte,", "portanto,", "portanto ", "porque "),
    "Exemplification": ("por exemplo,", "por exemplo "),
    "Elaboration": ("em particular,", "ou seja,"),
    "Conclusion": ("em conclusão,", "em resumo,", "finalmente,", "finalmente "),
}
MARKERS_IT = {
    "Continuation": ("inoltre,", "inoltre ", "per di più,", "anche,", "anche "),
    "Contrast": ("al contrario,", "tuttavia,", "tuttavia ", "comunque,", "però,", "però ", "sebbene ", "ma "),
    "Causation": ("di conseguenza,", "pertanto,", "quindi,", "quindi ", "perché "),
    "Exemplification": ("per esempio,", "per esempio ", "ad esempio,"),
    "Elaboration": ("in particolare,", "cioè,", "cioè "),
    "Conclusion": ("in conclusione,", "in sintesi,", "infine,", "infine "),
}
MARKERS_NL = {
    "Continuation": ("bovendien,", "bovendien ", "daarnaast,", "daarnaast ", "tevens,", "ook,", "ook "),
    "Contrast": ("daarentegen,", "desondanks,", "niettemin,", "echter,", "echter ", "hoewel ", "maar "),
    "Causation": ("daardoor,", "daarom,", "daarom ", "dus,", "dus ", "omdat "),
    "Exemplification": ("bijvoorbeeld,", "bijvoorbeeld "),
    "Elaboration": ("in het bijzonder,", "namelijk,", "namelijk "),
    "Conclusion": ("tot slot,", "samengevat,", "ten slotte,", "uiteindelijk,"),
}
MARKERS_RU = {
    "Continuation": ("кроме того,", "кроме того ", "более того,", "помимо этого,", "также "),
    "Contrast": ("с другой стороны,", "напротив,", "тем не менее,", "тем не менее ", "однако,", "однако ", "хотя ", "но "),
    "Causation": ("в результате,", "следовательно,", "поэтому,", "поэтому ", "потому что ", "таким образом,"),
    "Exemplification": ("например,", "например "),
    "Elaboration": ("в частности,", "в частности ", "а именно,", "то есть "),
    "Conclusion": ("в заключение,", "подводя итог,", "в итоге,", "наконец,", "наконец "),
}
MARKERS_TR = {
    "Continuation": ("bunun yanı sıra,", "ayrıca,", "ayrıca ", "üstelik,"),
    "Contrast": ("buna karşın,", "öte yandan,", "bununla birlikte,", "ancak,", "ancak ", "fakat ", "ama "),
    "Causation": ("dolayısıyla,", "bu nedenle,", "bu yüzden,", "çünkü "),
    "Exemplification": ("örneğin,", "örneğin "),
    "Elaboration": ("özellikle,", "özellikle ", "yani,", "yani "),
    "Conclusion": ("sonuç olarak,", "özetle,", "son olarak,"),
}
MARKERS_PL = {
    "Continuation": ("ponadto,", "ponadto ", "dodatkowo,", "również,", "również ", "także,", "także "),
    "Contrast": ("z drugiej strony,", "natomiast,", "natomiast ", "jednakże,", "jednak,", "jednak ", "ale "),
    "Causation": ("w rezultacie,", "w związku z tym,", "dlatego,", "dlatego ", "ponieważ "),
    "Exemplification": ("na przykład,", "na przykład "),
    "Elaboration": ("w szczególności,", "to znaczy,", "to znaczy "),
    "Conclusion": ("podsumowując,", "w podsumowaniu,", "wreszcie,", "wreszcie "),
}
MARKERS_ZH = {
    "Continuation": ("此外，", "此外", "另外，", "而且，", "而且", "同样，", "同时，", "同时"),
    "Contrast": ("相反，", "然而，", "然而", "不过，", "但是，", "但是", "虽然", "尽管"),
    "Causation": ("因此，", "因此", "所以，", "所以", "因为", "由于"),
    "Exemplification": ("例如，", "例如", "比如，", "比如"),
    "Elaboration": ("具体来说，", "特别是，", "特别是", "也就是说，", "即，"),
    "Conclusion": ("总之，", "总之", "综上所述，", "总结来说，", "最后，", "最后"),
}
MARKERS_JA = {
    "Continuation": ("さらに、", "さらに", "また、", "また", "加えて、", "その上、", "同様に、"),
    "Contrast": ("一方で、", "一方、", "それにもかかわらず、", "しかしながら、", "しかし、", "しかし", "けれども、", "ただし、", "だが、"),
    "Causation": ("その結果、", "したがって、", "したがって", "そのため、", "なぜなら"),
    "Exemplification": ("例えば、", "例えば", "たとえば、"),
    "Elaboration": ("具体的には、", "特に、", "特に", "すなわち、", "つまり、", "つまり"),
    "Conclusion": ("結論として、", "要するに、", "まとめると、", "最後に、", "最後に"),
}
MARKERS_KO = {
    "Continuation": ("게다가 ", "또한 ", "뿐만 아니라 ", "마찬가지로 "),
    "Contrast": ("반면에 ", "그럼에도 불구하고 ", "그러나 ", "하지만 ", "그렇지만 "),
    "Causation": ("그 결과 ", "따라서 ", "그러므로 ", "왜냐하면 "),
    "Exemplification": ("예를 들어 ", "예컨대 "),
    "Elaboration": ("구체적으로 ", "특히 ", "즉 "),
    "Conclusion": ("결론적으로 ", "요약하면 ", "마지막으로 "),
}
MARKERS_AR = {
    "Continuation": ("بالإضافة إلى ذلك،", "علاوة على ذلك،", "فضلاً عن ذلك،", "كذلك ", "أيضاً "),
    "Contrast": ("على العكس من ذلك،", "في المقابل،", "مع ذلك،", "ومع ذلك،", "لكن ", "إلا أن ", "غير أن "),
    "Causation": ("نتيجة لذلك،", "بالتالي،", "لذلك،", "لذلك ", "لأن ", "بسبب "),
    "Exemplification": ("على سبيل المثال،", "مثلاً،", "مثلاً "),
    "Elaboration": ("بشكل خاص،", "تحديداً،", "أي أن "),
    "Conclusion": ("في الختام،", "خلاصة القول،", "باختصار،", "أخيراً،", "أخيراً "),
}
MARKERS = {
    "en": MARKERS_EN, "de": MARKERS_DE, "fr": MARKERS_FR, "es": MARKERS_ES, "pt": MARKERS_PT, "it": MARKERS_IT, "nl": MARKERS_NL,
    "ru": MARKERS_RU, "tr": MARKERS_TR, "pl": MARKERS_PL, "zh": MARKERS_ZH, "ja": MARKERS_JA, "ko": MARKERS_KO, "ar": MARKERS_AR,
}


def marker_phrases(lang: str) -> list[tuple[str, str]]:
    """(phrase, marker) in matching order."""
    return [(phrase, marker) for marker, phrases in MARKERS.get(lang, {}).items() for phrase in phrases]


def parse_language(name: str) -> str:
    """A code of ``LANGUAGES`` or "auto"."""
    low = name.lower()
    found = next((code for code, others in LANGUAGES.items() if low == code or low in others), low if low == "auto" else None)
    if found is None:
        raise ValueError(f"unknown language {name!r}: one of {', '.join(LANGUAGES)}, auto")
    return found
