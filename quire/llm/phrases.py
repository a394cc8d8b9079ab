"""Example texts of residue and of sentences about it, as phrase grammars.

A pattern stands for all texts that its alternatives ``{a|b|}`` give; every pattern weighs the
same, however many texts it gives. The patterns are written from what is public: the reason
phrases of RFC 9110, the pages of browsers, servers and publishing tools, and the prompts of
office and article templates, in English, French, German and Spanish.
"""

from __future__ import annotations

import itertools
import re

_CHOICE = re.compile(r"\{([^{}]*)\}")


def expand(pattern: str) -> list[str]:
    """All texts of a pattern, with single blanks."""
    parts = _CHOICE.split(pattern)
    choices = [[p] if k % 2 == 0 else p.split("|") for k, p in enumerate(parts)]
    return [re.sub(r" (?=[.,:;!?])", "", " ".join("".join(c).split())) for c in itertools.product(*choices)]


_SITE = "{page|site|article|document|app|viewer}"
_SCRIPT = "{JavaScript|scripts|scripting|cookies and JavaScript}"
_PART = "{abstract|title|text|introduction|main theorem|main result|summary|conclusion}"

PATTERNS: dict[str, list[str]] = {
    "filler": [
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
        "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
        "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
        "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
        "{lorem|ipsum|dolor|magna|tempor} {lorem|ipsum|dolor|magna|tempor} {lorem|ipsum|dolor|magna|tempor}",
        "Gallia est omnis divisa in partes tres, quarum unam incolunt Belgae, aliam Aquitani, tertiam qui ipsorum lingua Celtae, nostra Galli appellantur.",
        "Arma virumque cano, Troiae qui primus ab oris Italiam fato profugus Laviniaque venit litora, multum ille et terris iactatus et alto vi superum.",
        "Quo usque tandem abutere, Catilina, patientia nostra? Quam diu etiam furor iste tuus nos eludet? Quem ad finem sese effrenata iactabit audacia?",
        "Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit, sed quia non numquam eius modi tempora incidunt.",
        "{The quick brown fox jumps over the lazy dog.|Sphinx of black quartz, judge my vow.|Pack my box with five dozen liquor jugs.}",
        "{asdf|qwerty|blah|foo bar|test} {asdf|qwerty|blah|foo bar|test} {asdf|qwerty|blah|foo bar|test}",
    ],
    "notice": [
        "{|Error |HTTP }{400 Bad Request|401 Unauthorized|403 Forbidden|404 Not Found|408 Request Timeout|410 Gone|429 Too Many Requests|500 Internal Server Error|502 Bad Gateway|503 Service Unavailable|504 Gateway Timeout}",
        "{Bad Request|Unauthorized|Forbidden|Not Found|Internal Server Error|Bad Gateway|Service Unavailable|Gateway Timeout|Too Many Requests} {(500)|error}",
        "{Error 404:|404:|404 -|404 –|HTTP error 404.|} {Page|File|Document} not found",
        "The {requested|} {page|URL|file|document|resource|address} {could not be found|was not found|cannot be found|does not exist} {on this server|}.",
        "{Sorry|We're sorry|Oops}, {the|this} {page|article|file} {you are looking for|you requested|} {does not exist|no longer exists|could not be found|has been moved or deleted}.",
        "You {do not|don't} have {permission|the right} to {access|view|open|read} this {page|resource|document|file|manuscript|server}.",
        "{Access|Permission} {denied|is denied|was denied} {|to this page|- please sign in}",
        "Your session {has expired|has timed out|is no longer valid}. {Please |}{log in|sign in} again {|to continue|to read the article|to view this page}.",
        "{Something|Sorry, something} went wrong {|on our end|on our side|while loading the page}.",
        "An {unexpected|internal|unknown} error {has occurred|occurred} {|while processing your request}.",
        "{Reference|Request ID|Error ID|Ray ID}: {4f2a91c7|b03d5e18|9c7e60af|e18b7d32}",
        "{Please try|Try|You may try} again {later|in a few minutes|shortly|in 30 seconds}.",
        "{Retry in|Please wait|Try again in} {5|10|30|60} {seconds|minutes}.",
        "{Slow down|Wait a moment|Please wait} and {reload|refresh} {the|this} page.",
        "{Too many|You have sent too many} requests {|in a given amount of time|from your address}. {Slow down.|Rate limit exceeded.|}",
        "The {server|service|site|website|upstream|upstream server|backend|proxy|host} {did not respond|did not answer|did not reply|timed out|returned an invalid response|refused the connection} {|in time}.",
        "{This|The} {service|site|server|page} is {temporarily|currently} {unavailable|overloaded|down for maintenance}.",
        "{Service|Site|Page} {temporarily|currently} unavailable.",
        "{Error establishing a database connection|Could not connect to the database|Database connection failed|Unable to connect to the database server}",
        "This {site|page} {can't|can’t|cannot} be {reached|loaded|displayed}{|: connection refused|: connection timed out|: connection reset}.",
        "The connection {was reset|was refused|has timed out|timed out|was interrupted}.",
        "Traceback (most recent call last): {Value|Key|Type|Name|Runtime|Index|Import|Attribute|Template}Error: {section|key|value|module|name} {missing|not found|is not defined}",
        "Application error: a {client|server}-side exception has occurred.",
        "{Undefined control sequence.|Missing $ inserted.|Emergency stop.|Fatal error occurred, no output PDF file produced!}",
        f"{{Please|Kindly|You must}} {{enable|activate|allow|turn on}} {_SCRIPT} {{in your browser|}} {{to|in order to}} {{view|read|use|display}} {{this|the}} {_SITE}.",
        f"{{Please|You need to|You must|You have to}} {{enable|activate|allow|turn on}} {_SCRIPT} {{in your browser|}} to {{continue|proceed|run this app}}.",
        "{JavaScript|Scripting} is {required|needed|necessary} to {display|show|view|use|read} {this|the} {formulas|content|page|article|text} {|on this page}.",
        "{JavaScript|Scripting} is {disabled|turned off|blocked|not enabled} {in|by} your browser.",
        f"This {{page|site|app|reader|viewer|article}} {{does not work|will not work|cannot be displayed|cannot work}} without {_SCRIPT}. {{Please enable it|Enable it}} {{and reload|and try again|to continue}}{{| the page}}.",
        "This {page|site|website|app|reader|viewer|article} {requires|needs} {JavaScript|scripts} {|to work|to run|to be enabled}.",
        "Your browser {does not support JavaScript|has JavaScript disabled|has scripts turned off|has scripting disabled|is blocking scripts}; {the|this} {page|site|reader|viewer} cannot {start|load|be shown|run}.",
        f"Checking {{your browser|if the site connection is secure|that you are human}} before {{accessing|opening|loading|entering}} {{the|this}} {_SITE} ...",
        f"{{Please enable|Enable}} {{cookies|JavaScript|cookies and JavaScript|JavaScript and cookies}} {{|to continue|and reload|and reload the page}}.",
        "{Verify|Verifying|Confirm} {you are|that you are} {human|not a robot}.",
        "{Veuillez|Merci d'|Il faut} activer {JavaScript|les scripts|les cookies} {|dans votre navigateur} pour {afficher|lire|consulter|voir} {cet article|cette page|ce document|ce site}.",
        "{Cette page|Ce site|Cette application|Ce lecteur} {a besoin de|nécessite|requiert|ne fonctionne pas sans} {JavaScript|scripts} {|pour fonctionner}.",
        "JavaScript est {désactivé|requis|nécessaire} {|dans votre navigateur}.",
        "{Erreur 404 :|404 :|404 –|} {page|document|fichier} {introuvable|non trouvée|inexistant}",
        "La page {demandée|que vous cherchez|} {n'existe pas|est introuvable|n'a pas été trouvée}.",
        "{Accès refusé|Accès interdit}. {Votre session a expiré.|Vous n'avez pas les droits nécessaires.|Veuillez vous reconnecter.|}",
        "Erreur interne du serveur. {Veuillez réessayer|Réessayez} {plus tard|dans quelques minutes|ultérieurement}.",
        "{Une erreur est survenue|Une erreur inattendue s'est produite}. Veuillez {réessayer|recharger la page}.",
        "{Service|Site} {temporairement|momentanément} {indisponible|inaccessible}.",
        "{Bitte|Sie müssen} {aktivieren Sie|schalten Sie} {JavaScript|Skripte|Cookies} {|in Ihrem Browser} {ein|}, um {diesen Artikel|diese Seite|den Inhalt|dieses Dokument} {anzuzeigen|zu lesen|zu sehen}.",
        "{Diese Seite|Diese Anwendung|Diese Website} {benötigt|erfordert|braucht|funktioniert nicht ohne} {JavaScript|Skripte}.",
        "JavaScript ist {in Ihrem Browser|} {deaktiviert|erforderlich|ausgeschaltet}.",
        "{404 –|404:|Fehler 404:|} {Seite|Datei|Dokument} nicht gefunden",
        "Die {angeforderte|gesuchte|} {Seite|Datei} {wurde nicht gefunden|existiert nicht|konnte nicht gefunden werden}.",
        "{Zugriff verweigert|Zugang verweigert|Kein Zugriff}. {Ihre Sitzung ist abgelaufen.|Bitte melden Sie sich erneut an.|Ihnen fehlt die Berechtigung.|}",
        "{Interner Serverfehler|Ein Fehler ist aufgetreten}. Bitte versuchen Sie es {später|in einigen Minuten} {erneut|noch einmal|wieder}.",
        "{Dienst|Seite|Server} {vorübergehend|derzeit} nicht {verfügbar|erreichbar}.",
        "{Active|Habilite|Por favor, active|Debe activar} {JavaScript|las cookies|los scripts} {|en su navegador} para {ver|leer|mostrar} {este artículo|esta página|este contenido|este documento}.",
        "{Esta página|Este sitio|Esta aplicación} {requiere|necesita|no funciona sin} JavaScript {|para funcionar}.",
        "JavaScript está {desactivado|deshabilitado} {|en su navegador}.",
        "{Error 404:|404 –|404:|} {página|archivo|documento} no {encontrada|encontrado}",
        "La página {solicitada|que busca|} {no existe|no se ha encontrado|no se encuentra}.",
        "{Acceso denegado|Acceso prohibido}. {Su sesión ha caducado.|Su sesión ha expirado.|No tiene permiso.|Inicie sesión de nuevo.|}",
        "{Error interno del servidor|Se ha producido un error}. {Inténtelo|Vuelva a intentarlo|Por favor, inténtelo de nuevo} {más tarde|en unos minutos}.",
        "{Servicio|Sitio} {temporalmente no disponible|no disponible temporalmente|no disponible en este momento}.",
    ],
    "prompt": [
        f"{{Your|The}} {_PART} {{goes|comes|belongs|should go}} here.",
        f"{{Insert|Add|Enter|Type|Put|Place|Paste}} {{the|your|a|some}} {_PART} {{here|in this place|in this section|below}}.",
        f"{{State|Describe|Summarise|Explain}} {{the|your}} {_PART} {{here|in one sentence|in a few words|in one paragraph}}.",
        "Replace this {text|paragraph|sentence|section|line} {with|by} {your own|the|a} {text|abstract|motivation|description|introduction} {|of the article|of the paper|of your work}.",
        "Write {one|two|a few|a short} {sentence|sentences|paragraph|lines} {per|about|for each|on each} {result|section|theorem|contribution}.",
        "Write {your|a short|the} {abstract|introduction|summary|section|conclusion} {here|in this place}.",
        "Click {here|to} {to add|add|to edit|to enter} {text|a title|your text}.",
        "{Section|Chapter|Subsection|Paragraph} {heading|title}",
        "{Title|Subtitle|Name|Short title|Running title} of the {article|paper|section|document|author|journal}",
        "{First|Firstname|First name|Given name|Author} {Last|Lastname|Last name|Surname|Name}, {Institution|Affiliation|University|Department}",
        "{Date: |}{YYYY-MM-DD|DD/MM/YYYY|MM/DD/YYYY|DD.MM.YYYY}",
        "Fill in {the|your} {details|name|affiliation|address|blanks} {here|below}.",
        "This {is a placeholder|is dummy text|is sample text|text is a placeholder}.",
        "{TODO|TBD|FIXME}: {write|complete|add|finish} {this section|the proof|the abstract|a reference}.",
        "To be {completed|written|announced|determined|filled in}.",
        "{Votre|Le} {résumé|texte|titre|introduction} {ici|vient ici}.",
        "{Insérer|Insérez|Ajouter|Saisir|Placer} {ici le|ici votre|le|votre} {théorème principal|résumé|texte|titre} {|ici}.",
        "{Remplacer|Remplacez} ce {paragraphe|texte} par {la motivation|votre texte|le résumé|l'introduction} {|de l'article}.",
        "{Écrivez|Écrire|Rédigez|Décrire} {ici |}{votre résumé|une phrase par résultat|le résultat principal|l'introduction} {|en une phrase|ici}.",
        "{Titre|Sous-titre|Nom} de {l'article|la section|l'auteur}",
        "{Prénom|Prénoms} {Nom|NOM}, {Établissement|Université|Affiliation|Institution}",
        "{Date : |}{JJ/MM/AAAA|AAAA-MM-JJ}",
        "Hier {steht|folgt|kommt} {die Zusammenfassung|Ihr Text|der Titel|die Einleitung}.",
        "Hier {den Hauptsatz|die Zusammenfassung|den Text|Ihren Text|den Titel} {einfügen|eingeben|eintragen|schreiben}.",
        "{Ersetzen Sie diesen|Diesen} {Absatz|Text} durch {die Motivation|Ihren Text|die Einleitung} {|des Artikels} {|ersetzen}.",
        "{Schreiben|Beschreiben|Nennen} Sie {hier|kurz} {Ihre Zusammenfassung|das Hauptergebnis|die Einleitung}.",
        "{Titel|Untertitel|Name} {des Artikels|des Abschnitts|des Autors}",
        "{Vorname} {Nachname|Name}, {Einrichtung|Universität|Institut|Institution}",
        "{Datum: |}{TT.MM.JJJJ|JJJJ-MM-TT}",
        "{Su|El} {resumen|texto|título} {va|viene} aquí.",
        "{Insertar|Inserte|Añadir|Escribir|Introduzca} aquí {el|su} {teorema principal|resumen|texto|título}.",
        "{Sustituir|Sustituya|Reemplace|Reemplazar} este {párrafo|texto} por {la motivación|su texto|el resumen} {|del artículo}.",
        "{Escriba|Describa} {aquí|brevemente} {su resumen|el resultado principal|la introducción}.",
        "{Título|Subtítulo|Nombre} {del artículo|de la sección|del autor}",
        "{Nombre} {Apellido|Apellidos}, {Institución|Universidad|Afiliación}",
        "{Fecha: |}{DD/MM/AAAA|AAAA-MM-DD}",
    ],
}

#: Sentences that speak of such things, as a part of natural prose.
SPOKEN = [
    "{When|If|Whenever} a {request|fetch|download} fails, the {client|crawler|script} {logs|records|reports} the {error|internal error} of the {server|host} and {tries again|continues|goes on}.",
    "The {session|token|login} {expires|ends} after {an hour|a day}, and {access|the page} is {denied|closed} until the {reader|user} {logs in|signs in}.",
    "A {reader|visitor|browser} without {JavaScript|scripts} {sees|gets|receives} the {formulas|text|content} as {plain text|images|source}.",
    "{Scripts|Cookies} are not {required|needed|used}, because the page is {rendered|built} before it is {served|sent} to the browser.",
    "The {title|abstract|summary} of the {article|paper|section} {names|states|mentions|summarises} the {main theorem|main result|setting}.",
    "The {abstract|introduction|summary|date} is {written|checked|revised} {last|first} by the {author|authors|editor}.",
    "{No counterexample|A proof|The converse|A reference} was {not found|found} in the {literature|survey|archive}; the {error term|page number|access} {is|remains} {open|unknown|missing}.",
    "{Access to|Permission for} the {ledger|repository|archive} is {denied to|restricted for} {scripts|guests|readers} by {design|default}.",
    "{Der Beweis|Die Aussage|Der Titel|Die Zusammenfassung} {des Satzes|des Artikels|des Abschnitts} {steht|folgt|findet sich} im {ersten|zweiten|letzten} {Abschnitt|Kapitel|Teil} {des Artikels|der Arbeit|des Buches}.",
    "{Der Server|Die Seite|Das Skript} {meldet|protokolliert|zeigt} den {Fehler|Zugriff} und {versucht es|beginnt} {später|morgen} {erneut|noch einmal}, wenn die {Sitzung|Verbindung} {abgelaufen|unterbrochen} ist.",
    "{Le titre|Le résumé|La preuve|L'introduction} {de l'article|de la section|du théorème} {résume|précède|décrit|contient} {le résultat principal|les définitions|la suite|le théorème}.",
    "{Le serveur|La page|Le script} {signale|consigne} {l'erreur|l'accès} et {recommence|continue} {plus tard|le lendemain}, quand la {session|connexion} {a expiré|est fermée}.",
    "{El título|El resumen|La prueba|La introducción} {del artículo|de la sección|del teorema} {resume|precede|describe|contiene} {el resultado principal|las definiciones|el texto|el teorema}.",
    "{El servidor|La página|El programa} {señala|registra} {el error|el acceso} y {continúa|lo intenta} {más tarde|de nuevo}, cuando la {sesión|conexión} {ha caducado|se cierra}.",
]

#: Shapes of unfilled placeholders of public template languages; NAME stands for an identifier in
#: one of its styles, WORDS for a few words.
PLACEHOLDERS = [
    "{{NAME}}", "{{ NAME }}", "{{ NAME.NAME }}", "{{ NAME | NAME }}", "{% block NAME %}", "{%- if NAME %}", "<%= NAME %>", "<% NAME %>", "${NAME}", "#{NAME}", "%%NAME%%", "@@NAME@@", "$NAME$", "__NAME__", "«NAME»",
    "<WORDS HERE>", "<your-NAME>", "<your WORDS>", "<insert WORDS>", "<NAME>", "[insert WORDS here]", "[insert WORDS]", "[your WORDS]", "[add WORDS]", "[enter WORDS]", "[TBD: WORDS]", "[TODO: WORDS]", "[tbd]", "[todo]", "[fill in WORDS]",
    "[placeholder]", "[Insérer WORDS]", "[votre WORDS]", "[WORDS einfügen]", "[hier WORDS]", "[Insertar WORDS]", "[su WORDS]", "[object Object]", "[[NAME]]", "%s", "%d", "{0}", "{1}", "{}",
]
NAMES = ["title", "author", "TITLE", "AUTHOR", "first_name", "FIRST_NAME", "Name", "first-name", "item1"]
WORDS = ["title", "name here", "TITLE", "FULL NAME", "Title", "first name", "the main text"]


def placeholder_examples() -> list[str]:
    """The shapes filled with names of every style."""
    out = []
    for shape in PLACEHOLDERS:
        fill = NAMES if "NAME" in shape else WORDS if "WORDS" in shape else [""]
        out += [shape.replace("NAME", f).replace("WORDS", f) for f in fill]
    return out
