"""Labelled training text for the tagger: generated sentences with typed spans, and look-alikes without.

Names, places, hosts and numbers are composed from syllables and digits at random, so that the model
learns forms and contexts instead of words.  Run as a module to train and write the weights.
"""

from __future__ import annotations

import re
import sys

import numpy as np

from corvine.llm.tagger import KINDS, TAGS, fit, tag_windows

WINDOW = 160
# Building blocks of generated text.
ONSETS = "b br c ch d dr f fr g gr h j k kh l m n p pr r s sh st t th tr v w y z bl fl qu".split()
NUCLEI = "a e i o u ai ea ei ia oa ou ee".split()
CODAS = "n r l s m t d k x nd rt st ck ll ss th".split() + [""] * 12
NAME_ENDS = (
    "son sen man mann berg stein stad stead mere moor by vard quist aro ova ov ev escu wick thorne raine draine holt lund"
    " ington ham ello elli etti ett ez ski sky ic er ler ton ley ford field well wood shaw ini ino ane eau ard nen"
).split()
GIVEN = (
    "Aisling Amina Anton Bruno Callum Dmitri Elin Emeka Felix Freya Greta Hana Hugo Idris Ilse Ines Jonas Keiko Kofi Leila"
    " Lotte Luca Mara Marta Mateo Naomi Noor Oskar Owen Pavel Priya Ravi Sofia Soren Stefan Tariq Tobin Vera Yusuf Zainab Anna"
    " Serena Grace George Olivia Fiona Emma Noah Liam Ethan Lucas Clara Alice Karl Nils Emily Harry Jack Oliver Amelia Thomas William Sarah David Michael"
    " Robert James Linda Susan Laura Kevin Brian Diego Pablo Elena Ivan Olga Mehmet Ahmed Mei Akira Kenji Rosa Paul Louise Émile Zoë Björn Łukasz"
    " Peter Maria John Julia Omar Chen Yuki Pierre Lucia Carlos Fatima Igor Nadia Tom Ruth"
).split()
# Further family names, of several languages, and given names with a dash.
FAMILY = (
    "Smith Jones Lopez Garcia Fernandez Rossi Bianchi Mueller Müller Schneider Weber Dubois Lefèvre Moreau Silva Santos Pereira Novak Kowalski Nowak Ivanov Petrov"
    " Yilmaz Kaya Haddad Nasser Cohen Levi Tanaka Suzuki Sato Nguyen Tran Kim Park Lee Wang Zhang Chen Singh Patel Kumar Okafor Mensah Adeyemi Andersson Nielsen"
    " Hansen O'Brien O’Connor McDonald MacLeod Picard Cruz Martinez Johnson Brown Taylor Wilson Clark Walker Young King Wright Hill Green Baker Murphy Kelly"
).split()
DASHED = "Jean-Luc Jean-Pierre Anne-Marie Hans-Peter Karl-Heinz Marie-Claire Ana-Maria Mary-Kate Min-jun Ji-woo".split()
HAN = "王 李 张 陈 田中 佐藤 鈴木 高橋 山本 김 박".split(), "小明 伟 芳 健太 花子 太郎 美咲 민준 서연".split()
PARTICLES = "van|van der|van den|von|von der|zu|de|de la|de los|del|della|di|da|dos|du|la|le|el|al|bin|ben|ter".split("|")
MARKED = dict(zip("acegilnorsuyzt", "á ć ę ğ ı ł ň ő ř š ů ý ž ț".split()))
OTHERS = (
    tuple("а е и о у я ов ин ан ев ко на ри ло ва де ми та сер пет ник гор бор лен дим вик пав".split()),
    tuple("α ε η ι ο ω ος ης ας άκη νι κο πα γι δη μα λε ρα στα θα σο κα τρι βα".split()),
)
COMMON = (
    "the a of to and for with on in by when that is are was before after until while each every old new hot cold data search"
    " index queue peer token bucket cluster panel page sort open set raise read write keep drop users events records limit value"
    " seconds minutes days release version note system license manager forwarder runner policy table lookup field role alert"
    " action retention summary model pipeline restart takes effect wait then make sure check compare first host node source type"
).split()
CAPITAL = (
    "Quarry Ember Tallow Lodestar Pinion Forwarder Secure Cloud Core Observe Stream Relay Vault Apm Guide Manual Digest Network"
    " Search Install Admin Data Release Patch Answers Weekly Archive Host Aliases Raw Events User Roles Playbook Metric"
    " Synthetics Sdk Js Py Rum Soar Intel Mission Charts Icons Ui Edge Hub Mobile Addon Database Endpoint Fieldguide Glossary"
).split()
# Places and firms, which are no persons.
ELSEWHERE = (
    "South Korea|New Zealand|United Kingdom|Saudi Arabia|Costa Rica|Sri Lanka|North America|Latin America|Hong Kong|San Marino|New York|Los Angeles|San Diego"
    "|Buenos Aires|Cape Town|Tel Aviv|Kuala Lumpur|Google Cloud|Amazon Web Services|Microsoft Azure|Red Hat|Visual Studio|Internet Explorer|Active Directory|Apache Spark"
    "|Mac OS|Linux Mint|Open Source|World Wide Web|Berlin|Tokyo|France|Madrid|Ohio|Siemens|Oracle|European Union|Middle East|West Coast|Open Telemetry|Black Friday|New Year"
).split("|")
SENTENCE_STARTS = (
    "The Each If When Where Since Unlike After Before Old Both Most Set Open Check Why Try Note By This Restart Run Do Nothing"
    " A Searches Users Der Die Falls Si Le La El Cambie Modifiez Prüfen"
).split()
# Words of other languages, with the letters English lacks.
FOREIGN = (
    "Größe Einträge Knoten Ereignisse Grenze Schlüssel Wörter ältere Zähler Puffer Prüfen Ändern Löschen Fügen starten antwortet übernimmt gesetzt verwirft Dienst Sekunden Zeilen"
    " réglage entrées nœud événements défini dépasse après même clé supprime relancez données fenêtre modifie règle lignes secondes serveur élément"
    " índice año máximo líneas después también según configuración tamaño reinicie nodo clave número más antiguos búsqueda registro"
    " più già perché però nodo chiave voce righe secondi não são até depois também chave versão limite węzeł każdy wartość większy błąd"
).split()
STREETS = "Street St. Road Rd Lane Ln Avenue Ave Drive Dr Court Crescent Blvd Boulevard Way Place Square Close Terrace".split()
GERMAN = "straße gasse weg allee platz ring damm".split()
FRENCH = ("rue", "avenue", "chemin", "boulevard", "place", "impasse", "quai")
SPANISH = ("Calle", "Avenida", "Plaza", "Paseo", "Camino")

# [a|b|] is one of several wordings; {N} {E} {P} {I} {A} are pieces; %w a word, %C a product word, %U one
# in capitals, %Z a place or firm, %h a syllable, %1 to %9 that many digits, %x hexadecimal digits.
TEMPLATES = """
[Please|Kindly|You may|We|Then|] [contact|email|ring|page|ping|notify|tell|ask] {N} [at|on|via|under|by] {P}[.| for details.| before noon.]
[Yesterday|Last week|Later|Then|Today|Once|] {N} [called|met|asked|thanked|joined|visited|told|praised] {N}[ to %w|][.| again.| and {N}.]
{N} / {P}[| / {E}]
{N} [[at|via] {E}]
{N} [et|und|y|e|and|&|och] {N} [ont|haben|han|have] %w %w.
[The shop|Our stand|My flat|His house|A desk] [at|in] {A} [for|is|was|has] %w %w.
%w %w, {I}, [living|seen|met|staying|registered] at {A}.
[Le|Der|El|The] [numéro|Anschluss|teléfono|number] [de|von|of] {N} [est le|ist|es|is] {P}, [son identifiant|die Kennung|su número|the id] {I}.
- %w_id=%3 [tax_id|vat_id|nif|ssn|id_no]={I} %w_%w=%3
[Ask|Meet|See|Visit|Call|Tell|Consult|Invite|Follow|Thank|Fragen Sie|Treffen Sie|Rufen Sie|Erreichen Sie|Informieren Sie|Appelez|Remerciez|Busque a] {N} [or|and|before|if|about|when|oder|und|ou|o|bevor] %w[ {E}| {P}| %w|] %w[.| %w.]
[Ask|See|Tell|Consult] [%w %w|the %w] [or|and|before|about] %w %w[.|; then {N}.]
[All|Some|Both|Many] [thanks|greetings|credits] [go |]to {N}[, {N}|] and {N} for [the|all] %w.
%w %w %w {A}, where {N} %w the %w[.| and {N} %w.]
- [%w_id|id|ssn|%w_no|nif]={I} %w_%w=%3 %w=%2
- [%w_to|%w_at|site|%w_address]={A}[| %w=%2]
[Only|Both|Here] {I} [was|is|were] %w [in|on|by] the %w, {I} [was|is] [not|kept|lost|%w].
%w the %w {P}, then {P} [if|when|and] %w %w.
%w %w %w on {P} [at|by|in|before] %w. %s %w %w.
[Questions|Complaints|Feedback|Invoices|Patches|Bug reports] [go|may be sent|should go|can be mailed] to {E}[.|, please.| only.]
[Mail|Email|E-mail|Contact|From|To|Cc|Reply-To|Sender][:|: |: <|]{E}[|>|.|;]
[Name|Full name|Contact|Author|Editor|Maintainer|Owner|Reviewer|Approved by|Assignee|Prepared by|Manager][:| -|] {N}
[Phone|Tel|Tel.|Telephone|Mobile|Cell|Fax|Hotline|Direct line|Office|Call us][:| -|] {P}
[Address|Ship to|Bill to|Location|Office|Headquarters|Mailing address|Return address|Visit us at][:| -|,|] {A}
[SSN|Social security number|Tax number|Tax id|National id|Passport|Passport no.|Insurance number|VAT id|Id card|Personal number|NINO|Account holder id][:| is| was| -|] {I}
My name is {N}[.| and I run the %w %w.|, I wrote the %w.]
[I am|This is|Here is|It was|That was] {N} [from|of|at] the %w [team|desk|group|office][.|; my number is {P}.|, reach me at {E}.]
{N}[ and|, | or|;] {N} [wrote|reviewed|approved|signed|tested|fixed|reported|translated|presented] [this|the|that] %w[.| last %w.| on the first day.]
[Written|Reviewed|Reported|Signed|Approved|Checked|Owned|Recorded|Translated|Sent] by {N}[.| ({E}).|, {E}.| on %4-0%1-1%1.|]
[Credits|Kudos|Regards|Hats off|Applause|Many thanks|A big thank you] to {N}[.| for the %w.|, {N} and {N}.]
[Best regards|Sincerely|Cheers|Yours|Mit freundlichen Grüßen|Cordialement|Saludos], {N}
According to {N}, the %w [needs|wants|has|keeps] %2 %w.
Our [colleague|neighbour|engineer|auditor|clerk|nurse|driver|lawyer] {N} [lives at|moved to|works from|was seen at] {A}[.| and answers on {P}.]
[Send|Post|Deliver|Forward|Return|Mail] [the|all|each] %w to {A}[.|, or fax {P}.| by Friday.]
[The parcel|The letter|A courier|The badge|One crate] [went|goes|was sent|leaves for] [to|from] {A}[.| at noon.]
[The plant|Our branch|The depot|The store] [is|sits|stands] at {A}, [opposite|next to|behind] the %w.
{N}, {A}, {P}
{N} <{E}>[,| wrote:| on the list:]
{N};{E};{P};{I}
{N},{E},{P}
"{N}","{A}","{I}"
| {N} | {P} | {E} |
| %2 | {N} | %w | {I} |
| {E} | %w | {N} |
| {A} | {P} |
|{N}|{A}|%3|
* {N} - {P}
- {N} ({E})
%1. {N}, {I}
- contact={E} region=%w level=%2
- home={A}
- name={N} id={I}
[mail_to|alert_address|admin_email|sender|recipient|%w_mail|%w.email] = {E}
[phone|callback|pager|%w_phone]: "{P}"
{{"[name|user|owner|author|person]": "{N}", "[mail|email|contact]": "{E}", "%w": %2}}
{{"[phone|tel|mobile]": "{P}", "[ssn|passport|tax_id|id]": "{I}"}}
<[author|person|owner|creator]>{N}</[author|person|owner|creator]>
<a href="mailto:{E}">{N}</a>
// [TODO|FIXME|XXX]([%w|%h]): ask {N} about %w_%w
# [written|owned|kept|edited] by {N}[|, {E}]
/* [Copyright|(c)] %4 {N} <{E}> */
%4-0%1-1%1T0%1:1%1:2%1Z [INFO|ERROR|DEBUG] user={E} [action|op]=%w src=10.%2.%2.%1
[ERROR|INFO] could not [send|deliver] [mail|report] to {E}: %w refused
login as {E} [succeeded|was denied] from 198.51.100.%2
[The caller|The customer|The patient|The visitor|A tenant] gave {I} [as|for] [proof|id|the number] and {P} [as|for] [call back|contact].
[The form|The export|Row %2|Our file] [shows|holds|contains|carries] {I}[,| and|;] {E}[| and {P}| next to {N}].
{I} [belongs to|is held by|was issued to] {N}[.|, {A}.]
[Number|Document|Card|Certificate] {I} [expired|was revoked|is still valid|was hidden, {I} was left].
Dial {P}[.| or {P}.|, extension %2, and ask for {N}.]
[If nobody answers|At night|In an emergency|Outside office hours], [use|try|call|dial] {P}[.| instead.]
[You can reach|We could reach|Nobody reached] {N} [on|at|under] {P}[.| or {E}.]
[The meeting|The review|The audit] with {N} [and {N} |]was moved[.| to %Z.]
[Herr|Frau] {N} [wohnt|arbeitet] in der {A}.
[Bitte wenden Sie sich an|Ansprechpartner ist|Verantwortlich:|Es schreibt Ihnen|Gezeichnet] {N}[.| (Tel. {P}).|, {E}.]
[Rufen Sie uns an|Telefon|Durchwahl|Handy|Erreichbar unter][:|] {P}[.|]
[Senden Sie die Ware an|Unsere Anschrift lautet|Lieferadresse:|Postanschrift:|Das Paket ging an] {A}[.|]
[Die Steuernummer|Die Ausweisnummer|Die Nummer] {I} [von|wurde] {N} [geprüft|gelöscht|zugeteilt].
[Schreiben Sie bitte an|Antworten gehen an|E-Mail:] {E}[.|]
[Veuillez écrire à|Adressez-vous à|Demandez à|Le responsable est|Rédigé par] {N}[.| ({E}).| au {P}.]
[Appelez le|Téléphone :|Joignable au|Composez le] {P}[.| avant midi.]
[Envoyez le colis au|Notre adresse :|Retour à l’adresse|Le bureau se trouve au] {A}[.|]
[Le passeport|Le numéro fiscal|La carte] {I} [est périmé|appartient à {N}|a été masqué].
[Hable con|Pregunte a|Contacte a|El autor es|Firmado por] {N}[.| en {E}.| ({P}).]
[Llame al|Teléfono:|Marque el] {P}[.| por la tarde.]
[Mande la caja a|Dirección:|La oficina está en|Entregar en] {A}[.|]
[El documento|El DNI|El pasaporte|La tarjeta] {I} [caducó|es de {N}|figura con {P}].
[Rivolgersi a|Scritto da|Parli con] {N}[.| ({E}).] [Chiamare|Telefono] {P}.
[Fale com|Escrito por|Procure] {N}[.| ({P}).] O CPF {I} foi apagado.
[Neem contact op met|Geschreven door|Bel] {N}[.| ({P}).]
[Proszę pisać do|Autor:|Kontakt:] {N}[, {E}| ({P})].
[Свяжитесь с|Назначен|Автор:|Пишет] {N}[.| для проверки.| ({E}).]
[連絡先は|作成者:|承認者は|お問い合わせは]{N}[です。|まで。|（{E}）。]
[電話は|内線は|電話:]{P}[です。|まで。|へ。]
[住所は|送付先:|発送は]{A}[です。|まで。|へ。]
[番号|証明書|旅券]{I}[は無効です。|を確認。]
""".strip().split("\n")

PLAIN = """
[The|Each|Every|This|No|Any|Our] %w %w [reads|keeps|drops|writes|needs|holds|splits|counts|waits for] %3 %w[.| per %w.| and one %w.]
[If|When|Where|Unless|Until|Before|After|Because] [the|a|no] %w [is|was|has] %w[, the %w|, each %w] [stops|starts|fails|waits|grows|shrinks].
%s %w [and|or|with|without|on|under] %w %w, %w %w[.|;|:]
[Set|Raise|Lower|Change|Leave|Check|Read|Compare|Keep|Unset] %w_%w [to|at|in|below] [%3|%w.conf|%w.yaml][.| first.| on %h-%h.| and restart.]
[Open|Edit|Create|Delete|Copy] [/opt/%w/%w.conf|C:\\%w\\%w\\%w|~/%w/%w.sh|$HOME/%w] and [set|add|remove] %w_%w=%2.
[Sign in|Connect|ssh] as [svc_%w@%h-%h|root@%h%2|admin@localhost|git@%h-%2|%w_%w@%w] [and|then|to] [list|find|see] %w %w.
[git clone|rsync|scp] [git@%h:%w/%w.git|%w@%h-%1:/var/%w]
@%w [param|return|deprecated|%w] %w_%w [since|until] %1.%1
[Job|The run|A backup|The scan] of %4-0%1-1%1 [1%1:2%1:3%1|at 0%1:1%1] [used|took|wrote|sent] [%4|%6|%8] [bytes|rows|%w] on [%h-%h|hub%2].
[Error|Event|Code|Status|Alarm] [0x%x%x|E%4|%h-%4|ERR-%3] [on|at|from] [10.%2.%1.%2|192.0.2.%2|2001:db8::%x] means [that |]the %w %w [fails|stops].
[Ticket|Case|Issue|Bug|Change|Request|Build] [%h-%4|QX-%5|#%5|%6] [tracks|covers|closes] [it|this|the %w %w].
[id|guid|uuid|trace|hash|commit|bucket] [%x-%x-%x|%x%x%x|%x%x-%4-%4-%x] [names|marks|is] one %w.
[Ports|Pages|Rows|Lines|Chapters|Sizes] [%4-%4|%4, %4|%2 to %3|%5/%4] [and %4 |][must be|are|stay] [open|empty|read|kept].
[Version|Release|Since|Before|Until|In] %1.%1[.%1|] [the|each|no] %w [was|is] %w.
[The limit|The cost|A licence|The fee|It] is [$%3|€%2.%2|%3,%3|%1.%3.%3|%2 %] per %w[.|, %w or %w.]
[Published|Updated|Edited|Checked|Printed] [%4-0%1-1%1|1%1 May %4|1%1/0%1/%4] [in|for|by] the %C %C [notes|team|desk|group|staff|guild|office].
[UPDATED|CHECKED|PRINTED|NOTE|WARNING] %4-0%1-1%1 [BY|FOR|IN] THE %U %U [TEAM|DESK|NOTES]
[Read|See|Open|Find|Search|Join] the %C %C [portal|manual|guide|forum|handbook|digest|page|tab|view|menu].
%C %C [is|was|runs|ships with|needs|replaces|and] %C %C[.| %1.%1.| on %Z.]
[Welcome to|Back to|Next:|About|Figure %1:|Table %1:|Part %1:|Step %1:] %C %C [%C|and %C|]
## %C %C [and|of|for|in] %C
# %s %w %w
**%C %C** %w %w %w [%w|%2].
%C %C > %C %C > %C
%C %C | %C %C | %C
%C / %C / %C %C
[Offices|Sites|Users|Fairs] in %Z, %Z and %Z [open|grow|meet] [in May|every spring|daily].
%Z [bought|supports|hosts|uses|leads|joined] %Z [in %4|since %4|].
[© %4|Copyright %4] %C %C [%Z|Group|Project|Foundation]. All rights reserved.
[Terms|Privacy|Marks|Notes] of %C %C [apply|are listed|may change].
[PRINT|SAVE|SHARE|COPY] [THIS PAGE|LINK|AS PDF] | [REPORT|RATE] [AN ERROR|IT]
%U %U %U [%U|%2]
| %s %w | [Default|Type|Value] | %w %w |
| %w_%w | %3 | %w %w of the %w |
| %C | %C %C | %1.%1 | [yes|no] |
|---|---|
index=%w_%w host=%h-%h [status=%3|user=%w] | [stats|top|count] %w by %w_%w
[%w://%h-%h]
%w_%w = [true|false|%3|%w|%h-%2:%4]
- %w_%w=%3 %w_%w=%w
{{"%w_%w": %3, "%w": "%w %w", "[id|ts|n]": %9%1}}
<%w %w="%3"><%w>%w %w</%w></%w>
def %w_%w(%w, %w=%2): return %w[%2] + %3
for %w in range(%3): print("%w", %w)
SELECT %w, count(*) FROM %w_%w WHERE %w > %3 GROUP BY 1
[Listen on|Browse to|Fetch|Call] https://%h.example.%w/%w/%w?%w=%3 [and|then] %w.
[See|Read] [the %w %w](../%w-%w.html)[.| and `%w_%w`.| first.]
{{%w|%s %w %w}} [[%w %w|%w]] ''%w'' &amp; \\%w{%w} $%w_%1 = \\frac{%2}{%w}$
%w at %w dot [the|each|a] %w; look at the %w (at least %2).
[Twenty|Three|Most|Some] %w at the %w dot their %w.
%1%1:%1%1:%1%1 %w[%3]: %w %w %w=%5 %w=%x
%3.%3.%3 %w, %3 %3 %3 %w, %2-%2-%4 %w, %3-%4 %w
[Order|Part|Model|Serial|Batch|Invoice|Key] [no. |number |]%h-%5-%2 [is|was] %w.
[Über|Nach|Bis zu|Mit|Ab|Unter|Pro] %3 %G [hinaus |]%G %G[.| und %G.] %G [Sie|er|es] %w_%w[ auf %h-%h|] [neu|an|aus].
%G Sie %w_%w in %w.conf und %G Sie den %G %h-%h %G. %G %G %G.
%G %G [le|la|el|los|las|di|do|der|die|das|den] %G %w à %3 %G. %G %3 %G.
[Le|La|El|Il|O|Der|Die] %G %G [passe à|pasa a|bleibt bei|vaut|es de] %3 %G[.|, %G.]
[Au-delà de|Más allá de|Oltre|Até] %3 %G, le %w %G [les|los|gli] %G %G.
[Published|Updated|Stand|Edited|Geprüft|Publié|Printed|Stored]  %D  [in|by|for|von|par] %C %C [notes|team|%w]
[On|From|Since|Until|Before|At|Am|Le|El] %D [the|one|no|der|la] %w %w[.|, %D.] [%D|%2] %w
%Q: %Q %Q %Q %Q AND %Q %Q %Q.
[from|by|of|with|for|in|to] [%C %C|**%C %C**|the %C %C][.|,|;|: %w|  | %w %w]
[Authors|Writers|By|Contributors|Made by|Edited by]: [the |]%C %C [%w circle|%w %w|team|staff|crew]
You [see|read|view] %w %w from [%C %C|%C %C %C|%C].[** |]
%C %C %w [group|team|desk]. [All|Some|Most] %w %w to their %w.
[Der|Die|Das|Jeder|Kein] %w [%w|%C] [verarbeitet|braucht|schreibt|liest|hält] %3 %w[.| pro %w.]
[Wenn|Falls|Bevor|Sobald] [der|die|das] %C %w %w, [startet|wartet|endet] %w_%w. [Seit|Ab] Version %1.%1 [gilt|fehlt] %w.
[Ändern|Prüfen|Öffnen|Lesen] Sie %w_%w in %w.conf[.| auf %h-%h.] Der %C %C [bleibt|wird] %w.
[Le|La|Chaque|Aucun] %w %w [lit|garde|écrit|attend] %3 %w[.| par %w.] [Si|Quand] %h-%h ne répond pas, %w %w.
[Modifiez|Ouvrez|Vérifiez] %w_%w dans %w.conf. [Depuis|Avant] la version %1.%1, %w %w.
[El|La|Cada|Ningún] %w %w [lee|guarda|escribe|espera] %3 %w[.| por %w.] [Si|Cuando] %h-%h no responde, %w %w.
[Cambie|Abra|Revise] %w_%w en %w.conf. [Desde|Hasta] la versión %1.%1, %w %w.
[Il|La|Ogni] %w %w [legge|scrive] %3 %w. [O|A|Cada] %w %w [grava|lê] %3 %w.
[バージョン|設定|値]%1.%1では%w_%wが%3になりました。%w.confを変更し、%h-%hを再起動します。
[検索|索引|キュー]の%wは%3件です。[既定値|上限]は%2です。
[Служба|Узел|Очередь] хранит %3 событий. [Если|Когда] %h-%h не отвечает, ждите.
""".strip().split("\n")


CHOICE = re.compile(r"\[([^\[\]]*\|[^\[\]]*)\]")
SLOT = re.compile(r"\{([NEPIA])\}|%([1-9wCUshZxGQD])|(\{|\})\3|.", re.S)


class Maker:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def one(self, options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def digits(self, n: int) -> str:
        return "".join(str(int(x)) for x in self.rng.integers(0, 10, n))

    def stem(self, syllables: int) -> str:
        return "".join(self.one(ONSETS) + self.one(NUCLEI) + self.one(CODAS) for _ in range(syllables))

    def given(self) -> str:
        if self.chance(0.05):
            return self.one(DASHED)
        return self.one(GIVEN) if self.chance(0.55) else self.stem(int(self.rng.integers(1, 3))).capitalize()

    def family(self) -> str:
        if self.chance(0.2):
            return self.one(FAMILY)
        s = (self.stem(1) + self.one(NAME_ENDS) if self.chance(0.85) else self.stem(2)).capitalize()
        return s + "-" + (self.stem(1) + self.one(NAME_ENDS)).capitalize() if self.chance(0.12) else s

    def marked(self, word: str) -> str:
        """A word with some letters outside Latin-1."""
        s = "".join(MARKED[c] if c in MARKED and (k == 0 or self.chance(0.4)) else c for k, c in enumerate(word.lower()))
        return "-".join(x.capitalize() for x in s.split("-"))

    def other(self, kind: int) -> str:
        return "".join(self.one(OTHERS[kind]) for _ in range(int(self.rng.integers(2, 4)))).capitalize()

    def name(self) -> tuple[str, str]:
        """(title before the piece, name)"""
        g, f, k = self.given(), self.family(), self.rng.random()
        if self.chance(0.015):
            return "", self.one(HAN[0]) + self.one(HAN[1])
        if self.chance(0.1):
            g = f"{g} {self.given()}"
        if self.chance(0.12):
            g, f = (self.marked(x) if self.chance(0.8) else x for x in (g, f))
        elif self.chance(0.06):
            kind = int(self.rng.integers(2))
            g, f = self.other(kind), self.other(kind)
        if k < 0.88 and not 0.5 <= k < 0.62 and self.chance(0.1):
            f = f"{self.one(PARTICLES)} {f}"
        if k < 0.5:
            s = f"{g} {f}"
        elif k < 0.62:
            s = f"{f}, {g}"
        elif k < 0.74:
            s = f"{g[0]}. {f}"
        elif k < 0.88:
            s = f"{g} {self.one('ABCDEFGHIJKLMNOPRSTW')}. {f}"
        else:
            s = f"{g} {f}".upper()
        return (self.one(("Dr. ", "Prof. ", "Ms. ", "Mr. ", "Mrs. ", "Dr. ", "Herr ", "Frau ")) if self.chance(0.15) else ""), s

    def email(self) -> tuple[str, str]:
        g, f = self.given().lower(), self.family().lower()
        user = self.one((f"{g}.{f}", f"{f}_{g}", f"{g[0]}{f}", f"{f}{self.digits(2)}", f"{g}+docs", f"{g}{self.digits(3)}", f"{g}-{f}"))
        host = self.one(("example.com", "example.org", f"{self.stem(2)}.example", f"uni.{self.stem(2)}.example", f"{self.stem(2)}-it.example.net", f"{self.stem(2)}.example.org", f"{self.stem(1)}mail.example", f"{self.stem(2)}docs.example"))
        if self.chance(0.3):
            host = f"{self.one((self.stem(1), self.stem(2), 'mail', 'post', 'web'))}.{self.one('com org net de fr es io co.uk edu ch info example'.split())}"
        k = self.rng.random()
        if k < 0.72:
            s = f"{user}@{host}"
        elif k < 0.84:
            s = f"{user} (at) {host}"
        elif k < 0.96:
            s = f"{user} [at] " + host.replace(".", " [dot] ")
        else:
            s = f"{user} at " + host.replace(".", " dot ")
        return ("mailto:" if self.chance(0.08) else ""), s.upper() if self.chance(0.05) else s

    def phone(self) -> tuple[str, str]:
        d = self.digits
        if self.chance(0.35):
            gap = self.one((" ", "-", ".", " ", ""))
            parts = [d(int(n)) for n in self.one(("334", "343", "2222", "24", "333", "44", "324", "26", "3322", "422", "45"))]
            lead = self.one((f"+{d(2)}{gap}", f"+{d(1)}{gap}", f"00{d(2)}{gap}", "0", f"({d(3)}){gap}", f"(0{d(2)}) ", f"+{d(2)} (0) ", "0", ""))
            s = lead + gap.join(parts)
            if 8 <= sum(c.isdigit() for c in s) <= 15:
                return "", s + (f" x{d(2)}" if self.chance(0.05) else "")
        return "", self.one((
            f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)}-555-0{d(3)}", f"({d(3)}) 555-0{d(3)}",
            f"555-0{d(3)} ext. {d(2)}", f"020 79{d(2)} 0{d(3)}", f"+44 20 79{d(2)} 0{d(3)}", f"+49 30 {d(5)} {d(3)}", f"030/{d(8)}",
            f"07{d(3)} {d(6)}", f"+1.{d(3)}.555.0{d(3)}", f"+1 {d(3)} 555 0{d(3)}", f"+61 2 5550 {d(4)}", f"+{d(2)} {d(3)} {d(4)} {d(3)}", f"0{d(3)}-{d(6)}",
        ))

    def idnum(self) -> tuple[str, str]:
        d, u = self.digits, self.one("ABCDEFGHJKLMNPQRSTVWXYZ")
        word = "passport " if self.chance(0.5) else ""
        k = self.rng.random()
        if self.chance(0.25):
            l = self.one("ABCDEFGHJKLMNPRSTWXYZ")
            return "", self.one((
                f"{l}{self.one('BCDEFGHK')}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}", f"DE{d(20)}", f"X{d(7)}{l}", f"{l}-{d(7)}-{u}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}",
                f"{l}{u}{d(6)}", f"{d(9)}", f"{d(11)}", f"{d(6)}-{d(4)}", f"{d(4)} {d(4)} {d(4)}", f"{u}{l}{d(2)}{u}{d(4)}{l}", f"{d(2)}-{d(7)}",
            ))
        if k < 0.24:
            return word if self.chance(0.9) else "", self.one((f"P0{d(7)}", f"X{d(7)}", f"ZZ{d(7)}", f"{u}{d(8)}", f"C{d(8)}"))
        return "", self.one((
            f"{d(3)}-{d(2)}-{d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"000 {d(2)} {d(4)}", f"QQ{d(6)}{self.one('ABCD')}", f"QQ {d(2)} {d(2)} {d(2)} {self.one('ABCD')}",
            f"{d(8)}-{u}", f"{d(8)}{u}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}",
        ))

    def address(self) -> tuple[str, str]:
        d, k = str(int(self.rng.integers(1, 300))), self.rng.random()
        road, town, post = self.stem(2).capitalize(), self.stem(2).capitalize(), self.digits(5)
        if self.chance(0.5):
            road += self.one(("field", "wood", "stone", "gate", "hill"))
        if self.chance(0.12):
            return "", self.one((f"{road}{self.one(GERMAN)} {d}", f"{d} {road} {self.one(STREETS)}", f"{self.one(FRENCH).capitalize()} {road} {d}", f"{road}{self.one(GERMAN)} {d}, {town}", f"Via {road} {d}, {town}", f"{road}straat {d}", f"ul. {road} {d}, {self.digits(2)}-{self.digits(3)} {town}", f"Rua {road}, {d}"))
        unit = f", {self.one(('Apt', 'Unit', 'Suite', '#'))} {self.digits(2)}" if self.chance(0.3) else ""
        end = self.one((f"{town} {post}", town, f"{town}, {post}"))
        if k < 0.46:
            return "", f"{d} {road} {self.one(STREETS)}{unit}, {end}"
        if k < 0.6:
            return "", f"{road}{self.one(GERMAN)} {d}{self.one(('', '', 'a', 'b'))}, {post} {town}"
        if k < 0.75:
            return "", f"{d} {self.one(('', 'bis '))}{self.one(FRENCH)} {self.one(('de la', 'des', 'du', 'de'))} {road}, {post} {town}"
        if k < 0.89:
            return "", f"{self.one(SPANISH)} {self.one(('del', 'de las', 'de la', 'de'))} {road} {d}{self.one(('', ', 2.º B', ', 1.º A'))}, {post} {town}"
        return "", f"P.O. Box {self.digits(4)}, {town}{self.one(('', ' ' + post))}"

    def elsewhere(self) -> str:
        if self.chance(0.6):
            return self.one(ELSEWHERE)
        return self.stem(2).capitalize() + self.one((" Labs", " Inc.", " GmbH", " Systems", " University", " Valley", " County", " Bank", " Ltd", " Cloud", " Airport"))

    def product(self) -> str:
        return self.one(CAPITAL) if self.chance(0.6) else self.one(COMMON).capitalize() if self.chance(0.6) else self.stem(int(self.rng.integers(1, 3))).capitalize()

    def date(self) -> str:
        y, m, d = int(self.rng.integers(1990, 2036)), int(self.rng.integers(1, 13)), int(self.rng.integers(1, 29))
        month = self.one("January February March April May June July August September October November December Jan Feb Mar Apr".split())
        s = self.one((f"{y}-{m:02}-{d:02}", f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m:02}/{d:02}/{y}", f"{d} {month} {y}", f"{month} {d}, {y}", f"{y}{m:02}{d:02}"))
        return s + (f" {self.digits(2)}:{self.digits(2)}:{self.digits(2)}" if self.chance(0.2) else "")

    def filled(self, t: str) -> tuple[str, list[tuple[int, int, str]]]:
        """A template's text and its (start, end, kind) spans."""
        while "[" in t and (m := CHOICE.search(t)):
            t = t[: m.start()] + self.one(m[1].split("|")) + t[m.end() :]
        make = {"N": ("name", self.name), "E": ("email", self.email), "P": ("phone", self.phone), "I": ("idnum", self.idnum), "A": ("address", self.address)}
        word = {
            "w": lambda: self.one(COMMON) if self.chance(0.75) else self.stem(int(self.rng.integers(1, 4))), "C": self.product, "U": lambda: self.product().upper(),
            "s": lambda: self.one(SENTENCE_STARTS), "h": lambda: self.stem(1) + (self.digits(1) if self.chance(0.3) else ""), "Z": self.elsewhere,
            "G": lambda: self.one(FOREIGN), "Q": lambda: self.one(COMMON).upper(), "D": self.date,
            "x": lambda: "".join(self.one("0123456789abcdef") for _ in range(int(self.rng.integers(4, 9)))),
        }
        text, spans = "", []
        for m in SLOT.finditer(t):
            if m[1]:
                kind, maker = make[m[1]]
                before, piece = maker()
                text += before
                spans.append((len(text), len(text) + len(piece), kind))
                text += piece
            elif m[2]:
                text += self.digits(int(m[2])) if m[2].isdigit() else word[m[2]]()
            else:
                text += m[3] or m[0]
        return text, spans

    def plain(self) -> str:
        return self.filled(self.one(PLAIN))[0]

    def labelled(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A line and its (start, end, kind) spans."""
        text, spans = "", []
        for k in range(int(self.rng.integers(1, 5))):
            more, own = self.filled(self.one(TEMPLATES) if k == 0 or self.chance(0.3) else self.one(PLAIN))
            if text and self.chance(0.5):
                text, spans, more, own = more, own, text, spans
            at = len(text) + 1 if text else 0
            text = f"{text} {more}" if text else more
            spans = spans + [(a + at, b + at, kind) for a, b, kind in own]
        return text, spans

    def window(self) -> tuple[str, np.ndarray]:
        """A window of at most WINDOW characters with its tags."""
        text, spans = (" ".join(self.plain() for _ in range(int(self.rng.integers(1, 4)))), []) if self.chance(0.4) else self.labelled()
        tags = np.zeros(len(text), np.int64)
        for a, b, kind in spans:
            i = 1 + 2 * KINDS.index(kind)
            tags[a] = i
            tags[a + 1 : b] = i + 1
        if self.chance(0.08):  # blanks doubled
            twice = np.array([1 + (c == " ") for c in text])
            text = "".join(c * 2 if c == " " else c for c in text)
            tags = np.repeat(tags, twice)
            starts = (tags % 2 == 1) & (np.r_[0, tags[:-1]] == tags)
            tags[starts] += 1
        size = WINDOW if self.chance(0.7) else int(self.rng.integers(20, WINDOW))
        if len(text) > size:
            at = int(self.rng.integers(0, len(text) - size + 1))
            if spans and self.chance(0.8):
                a, b, _ = self.one(spans)
                at = int(np.clip(a - self.rng.integers(0, size - 8), 0, len(text) - size))
            text, tags = text[at : at + size], tags[at : at + size]
            if tags[0] and tags[0] % 2 == 0:
                tags[0] -= 1
        return text, tags


def main(path: str, steps: int = 2200, seed: int = 11, start: str | None = None) -> None:
    """Train and write the weights; start: a file of weights to go on from."""
    maker = Maker(seed)
    first = {k: v.astype(np.float32) for k, v in np.load(start).items()} if start else None
    p = fit(lambda n: [maker.window() for _ in range(n)], steps, start=first, say=lambda k, loss: print(k, round(loss, 3), flush=True))
    held = Maker(99)
    rows = [held.window() for _ in range(1500)]
    got = tag_windows(p, [w for w, _ in rows])
    right = sum(int((g == t).sum()) for g, (_, t) in zip(got, rows))
    exact = sum(bool((g == t).all()) for g, (_, t) in zip(got, rows))
    print("characters right", right / sum(len(t) for _, t in rows), "windows right", exact / len(rows), len(TAGS))
    np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in p.items()})


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:4]), *sys.argv[4:])
