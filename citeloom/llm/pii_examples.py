"""The small labelled table that the tagger of personal information is trained on.

Sentences are patterns with labelled places and fillers, all written for this purpose: letters, notices, minutes and
reference prose as anyone might write them. Family names, towns and words are common ones or strung together from
random letters, so that the tagger learns shapes and neighbours, not a list. `UNSEEN` patterns are never trained on;
they measure it. `labelled_sentences` writes patterns out with a seed.
"""

from __future__ import annotations

import random
import re
from collections.abc import Sequence

# Common given names.
GIVEN = (
    "Abigail Agnes Albert Alexander Alfred Alice Amelia Andrew Anna Anthony Arthur Barbara Beatrice Benedict Benjamin Bernard Brigitte "
    "Camille Carlos Carmen Caroline Catherine Charles Charlotte Christian Christopher Claire Clara Daniel David Dieter Dorothy Douglas "
    "Edith Edmund Edward Eleanor Elena Elizabeth Emily Emma Ernest Eva Florence Frances Francis Frank Frederick Genevieve "
    "George Gerald Gertrude Grace Gustav Hannah Harold Harriet Heinrich Helen Helga Henry Herbert Hugo Ines Isabella Ivan Jacob James Jane Jean Joan "
    "Johanna John Jonathan Jorge Joseph Josephine Juan Julia Karl Katherine Klaus Laura Lawrence Leonard Lewis Lucia Ludwig Margaret Maria Marie "
    "Martha Martin Mary Matilda Maud Michael Miguel Nathaniel Nicholas Nora Oliver Oscar Pablo Patricia Patrick Paul Peter Philip "
    "Pierre Rachel Ralph Raymond Rebecca Richard Robert Rosa Rupert Ruth Samuel Sarah Simon Sofia Sophie Stephen Susan "
    "Sylvia Theodore Theresa Thomas Thomasina Ulrike Ursula Victor Vincent Virginia Walter William Winifred Xavier Yevgenia Yvonne Zachary "
    "Ebenezer Josephine Millicent Oswald Philippa Quentin Rosamund Susannah"
).split()
# Common family names.
FAMILY = (
    "Adams Allen Baker Bauer Becker Bell Bennett Bernard Blanc Braun Brooks Brown Butler Carter Castillo Chapman Clark Clarke Coleman Collins Cook Cooper Cox "
    "Davies Davis Delgado Dubois Edwards Ellis Evans Fischer Fisher Fletcher Fontaine Ford Foster Fournier Fuchs Garcia Gibson Girard Gomez Graham Grant Gray Green "
    "Griffin Hall Hamilton Harris Harrison Hartmann Herrera Hill Hoffmann Howard Hughes Hunter Jackson Jenkins Johnson Jones Kaiser Keller Kelly Kennedy King Klein "
    "Koch Lambert Lang Laurent Lefebvre Lehmann Lewis Lopez Marshall Martinez Mason Mercier Meyer Miller Mitchell Moore Morales Moreau Morgan Morris Müller Murphy "
    "Navarro Nelson Neumann Ortega Owen Palmer Parker Pearson Perez Peters Phillips Porter Powell Price Reed Renard Reyes Reynolds Richter Roberts Robinson Rogers "
    "Romero Ross Roussel Ruiz Russell Sanchez Schäfer Schmidt Schneider Scholz Schubert Schulz Scott Simpson Smith Stewart Taylor Thompson Torres Turner Vargas Vega "
    "Vogel Wagner Walker Walsh Ward Watson Weber Werner White Wilson Wolff Wood Wright Young Zimmermann"
).split()
# Common names and kinds of streets.
_STREETS = "Abbey Albert Bath Beech Birch Bridge Cambridge Canal Castle Cedar Chapel Cherry Chestnut Church Clifton Dover Elm Garden Grove Harbour High Hill Kings Lake Lime London Lower Main Manor Maple Market Meadow Mill North Oak Old Orchard Oxford Park Pine Pleasant Queens Railway River School South Spring Station Sunny Temple Union Upper Valley Victoria Water Well West Windmill York".split()
_KINDS = "Street Street Road Road Lane Lane Avenue Court Drive Terrace Close Way Square Place Blvd St. St Rd Ave Crescent Row Gardens Hill Walk Row".split()
_GERMAN = "Goethe Schiller Bahnhof Haupt Garten Kirch Berg Wald Rosen Mozart Beethoven Ring Burg See Wiesen Feld Mühlen Post Schloss Brunnen Tauben Birken".split()
_FRENCH = ("de la République", "Victor Hugo", "de l'Église", "des Lilas", "du Moulin", "Pasteur", "de la Gare", "des Écoles", "du Château", "Jean Jaurès", "de la Paix", "Voltaire", "des Rosiers", "du Marché", "Saint-Michel", "aux Fleurs")
_SPANISH = ("Mayor", "del Sol", "de la Paz", "San Juan", "de Cervantes", "Nueva", "de los Reyes", "Real", "de la Luna", "Santa Ana", "del Río", "Gran Vía", "de Goya", "del Prado")
TITLES = "Mr Mrs Ms Dr Prof Mr. Mrs. Ms. Dr. Prof. Herr Frau Mme M. Sr. Sra. Professor Sir".split()
# Common words of four languages, for the text between places.
_WORDS = (
    "about across against already among answer archive asked before began between books bought broken brought called carried census change children church city claims class clear closed "
    "common copies could council counted country course cousin custom daughter debate decline different district during early eastern evidence family farm father field figures first found garden given "
    "group growth harvest history house household income industry inquiry interview kept labour land large later learned letters library local market marriage meeting members migrants moved neighbours never "
    "notes observed often older opened orders others owners papers parents parish period places plans poor power practice press public rather record register rent reply report returned rules rural school "
    "season second several shared shows social sources spoke still stories street strikes study survey system tables taken teacher their theory therefore three trade trust union until urban value village visit wages "
    "walked women wrote workers younger"
).split()
_CAPITALS = "Archive Assembly Board Chamber Church Committee Conference Department Faculty Federation Festival Guild House Journal Library Market Ministry Museum Office Parliament Quarterly Record Register Review Studies Survey Theatre Treaty Union Arbeit Forschung Gesellschaft Geschichte Haushalt Kirche Sprache Stadt Verein Wirtschaft Zeitung".split()

# Patterns: {n} name, {m} mail, {p} phone, {i} identity number, {a} street address, {g} German, {f} French, {e} Spanish
# address; {s} family name, {t} town, {y} year, {w} word, {x} random word, {d} number, {d4} so many digits, {c} capital word.
POSITIVE = (
    # letters, notices and contacts
    "Kindly forward the parcel to {a} before noon.", "The parcel for {n} is held at {a}; the {w} {w}.", "Deliver to: {n}, {a}", "Sender: {n}, {a}, phone {p}.", "Our new postal address is {a}.", "He gave his address as {a} and hers as {a}.",
    "From {y} onward she lived at {a}.", "They moved to {a} in {y}.", "The landlord of {a} raised the rent by {d}.", "Her sister, {n}, still lives at {a}, we heard.", "The envelope bore only {a}.", "The notice went to {a}. {w} {w} in {t}, {w}.",
    "Queries: {m}", "For details mail {m}.", "For details mail {m} or telephone {p} during {w} hours.", "Reach the desk at {m}; the {w} {w}.", "He signs his mail {m} and rarely {w}.", "An answer from {m} came after {d} {w}.", "Copies may be had from {n} ({m}).",
    "Please telephone {p} after six.", "Her number is {p}.", "The clinic rang {p} twice; no one {w}.", "Tel. {p}", "Tel.: {p}, fax {p}.", "Mobile {p}; mail {m}.", "Text {n} on {p} if the {w} is {w}.", "My mobile number is {p}, said the {w}.", "Dial {p} and leave a message for {n}.",
    "The operator noted {p}, then wanted {n}.", "{n} may be called under {p}.", "{T} {n} can be had by telephone, {p}, or by mail, {m}.", "Author for contact: {n}, {a}, {m}.", "Address for letters: {T} {n}, {a}. E-mail: {m}.", "Address for letters: {n}, {a}; {m}. We show that {w} {w} {w}.",
    # numbers of persons
    "Passport {i} expired in {y}.", "Insurance number {i} belongs to {n}.", "Her insurance number was {i}. The {w} {w} in {t}.", "{n} (ID {i}) was admitted on the {d}th.", "{n}, ID {i}, tel. {p}", "We checked the permit, {i}, against the register.", "The card shows {i} and the name {n}.", "The licence no. {i} was issued to {n} of {t}.",
    "The file of {n}, no. {i}, is missing.", "The applicant {n} filled in {i} and gave {a} as residence.", "At {i} the register has {n}, {a}.", "Tax number {i}, holder {n}.", "Registered as {i} since {y}.", "The ticket named {n}, number {i}, resident at {a}.", "His permit, number {i}, was lost in {y}; the {w} {w}.", "Subject {n} was entered as {i} and later moved to {a}.",
    # names in running text
    "We owe much to {n} for reading a draft.", "Thanks go to {n}, {n} and {n}.", "Special thanks to {T} {n} of {t}, who answers at {p}.", "The authors thank {n}, reachable by {p}, and two readers.", "I first met {n} in {t}.", "On the {d}th we visited {n} at home.", "When asked, {n} laughed: ‘{w} {w}.’", "‘Come in,’ said {n}, ‘the {w} is {w}.’", "‘You want {n}, second door,’ the {w} told us, and wrote down {p}.",
    "“Talk to {n},” the guard advised.", "{n} kept the books of the {w} until {y}.", "{n} remembers the {w} of {y} well.", "{T} {n} remembers how {w} {w} the {w}.", "{n} was born in {t} in {y}.", "According to our landlady, {n}, the {w} {w}.", "A neighbour, {n}, had {d} {w}.", "The witness {n} was heard in {t}.", "Interviewee: {n}. Place: {t}. Date: {y}.", "Present: {n}, {n}, {n}.", "Minutes taken by {n}.", "Signed: {n}, {t}, {y}", "Yours sincerely, {n}", "Yours, {n} <{m}>", "{n} <{m}>: thank you for the {w}.", "{n} wrote from {m}: the {w} is {w}.",
    "Dear {T} {n}, the {w} has arrived.", "Mrs {n} and her son {n} left {t} in {y}.", "Our host was {n} ({p}), who kept {d} {w}.", "Our host {n} kept {d} {w}.", "We spoke with {n} of {a} on two days.", "{n} of {a} sold us the {w}.", "{T} {n} of {a} let us in.", "The talk with {n} lasted {d} minutes.", "The talk with {T} {n} took place in {t} in {y}.", "The questionnaire of {n} came back from {t}.", "Entries: {n}, no. {i}, {a}.", "I am {n}, my phone is {p}.", "Speaking is {n}; call me back on {p}.", "{n} here, the number is {p}.",
    # people named by what they are
    "Interviewee {n} said little.", "Informant {n} left {t} in {y}.", "Witness {n} signed with {i} and gave {a}.", "Tenant {n} paid {d} in {y}.", "Applicant {n} (number {i}) withdrew.", "Patient {n}, number {i}, was sent home.", "Respondents such as {n} were {w}.", "Voter {n} of {a} was struck off.", "Subscriber {i} is {n}.", "Diary: saw {n}, phone {p}, card {i}.", "Log of day {d}: rang {n}, number {p}.", "Memo: call {n}, mobile {p}, badge {i}.", "Visited {n}, telephone {p}, in {t}.", "Note to self: thank {n}.", "Claimant {n} lost.", "Lodger {n} paid {d}, then left for {a}.", "Pupil {n} of {t} came {w}.", "Nurse {n} wrote it down.", "Guest {n} signed with {i} and left.", "Clerk {n} knew {w}.", "Reader {n} wrote from {a}.", "The Mayor, {n}, {w}.", "Parcels to {n}, {a}.", "Parcels to {n}, {a}; {m}. They {w} {w}.", "Reprints from {n}, {a}.", "Proofs to {T} {n}, {a}. {w} {w}.", "Bills to {n} at {a}.", "Invoices: {n}, {a}.", "{n} can be had under {p}.", "The office is found under {p}.", "Ring {n} under {p}, or {p}.", "A long walk with {n} ended in {t}.", "Lunch with {n} was in {y}.", "A quarrel with {T} {n} dates from {y}.", "Breakfast with {T} {n} of {t}.", "My uncle {n} (phone {p}) {w} {w}.", "{n} (tel. {p}) {w} the {w}.", "The agent (phone {p}) {w}.", "Should it fail, call {p}.", "If lost, call {p} at once.", "Mail {m}, or call {p}, said the {w}.", "She left {p} with the porter.", "He left {p}, but no name.", "Whoever rang left {p} for {n}.", "{n} of {a} was the second guest.", "{n} of {a} and {n} of {a} {w}.", "{T} {n} of {a} was the second guest.", "He was then living at {a}.", "Both were living at {a} in {y}.", "{n} of {a} came by.", "{T} {n} of {a} came by; {w} {w}.", "A letter to {n}, {a}; {m}, came back.",
    "The list gives {n}, no. {i}, resident in {a}.", "The sheet names {n}, no. {i}.", "The roll shows {n}, born in {y}.", "The badge read {i}, the name {n}.", "On the slip stood the number {i}.", "A card with the number {i} lay there. {w} {w} {x}.", "The stamp carries the number {i}.", "Write to {m} or phone {p}.", "Mail {m} or phone {p}.", "Suggestions: {m}, or phone {p}.", "Mail us: {m}. Using {w}, the {c} {w}.", "Returns to {a}. The {w} {w}.", "Ask after {n}, whose number is {p}.", "Ask {n} downstairs, said the {w}.", "Go and see {n}, said the {w}.",
    # German
    "Wir danken {n} für das Gespräch.", "Das Interview mit {n} führten wir {y} in {t}.", "Das Interview mit {T} {n} dauerte {d} Minuten.", "Anfragen bitte an {m} oder unter {p}.", "Schreiben Sie an {m} oder rufen Sie {p} an.", "Der Pass {i} wurde auf {n} ausgestellt.", "Personalnummer {i}, {n}", "{n} wohnt in der {g}.", "{n}, {g}, berichtete von {y}.", "{T} {n}, gemeldet {g}, sagte nichts.", "Unsere Anschrift lautet {g}.", "Ausgewiesen hat sich {n} mit {i}.", "Die Klägerin {n}, wohnhaft {g}, erschien nicht.", "{T} {n}, wohnhaft {g}, schwieg.", "{n}, wohnhaft {g}, schwieg.", "Ausweis {i}, Inhaber {n}.", "Der Ausweis mit der Nr. {i} gehörte {n}.", "Kontakt: {m}, Telefon {p}.", "Fragen? {m} oder {p}.", "Wählen Sie {p}. {c} und {c} {x}.", "Pass Nr. {i} gehört {n}.", "Karte Nr. {i} ist die von {n}.", "Konto Nr. {i}, {n}.", "Ein Spaziergang mit {n} endete {y}.", "Der Briefwechsel mit {n} begann {y}.", "Der Streit mit {T} {n} begann {y} in {t}.", "Zeuge {n} schwieg.", "Mieterin {n} zog {y} aus.",
    # French
    "Nous remercions {n} pour son aide.", "Nous avons rencontré {n} à {t} en {y}.", "L'enquêtée, {n}, parlait de {y}.", "Contact : {m} ou {p}.", "Pour toute question, {m} ou téléphone {p}.", "Le passeport {i} est celui de {n}.", "{n} habite {f} depuis {y}.", "{n}, domicilié {f}, se souvient.", "{T} {n}, logée {f}, se souvient.", "Envoyez la lettre au {f}.", "Le numéro {i} correspond à {n}.", "Le plaignant {n}, demeurant {f}, a signé.", "{T} {n}, demeurant {f}, a signé.", "{n}, demeurant {f}, a signé.", "Écrivez à {m} ou appelez le {p}.", "Répondre à {m}, ou au {p}.", "Sa carte, n° {i}, porte le nom de {n}.", "Carte n° {i} : {n}.", "Nous avons revu {T} {n} à {t}.", "Depuis {t}, {T} {n} nous a écrit.", "Une promenade avec {n} date de {y}.", "Le repas avec {n} fut court.", "La rencontre avec {T} {n} eut lieu en {y}.", "La rencontre avec {n} est de {y}. Le {x} {x}.", "Témoin {n}, entendu à {t}.",
    # Spanish
    "Agradecemos a {n} su ayuda.", "Hablamos con {n} en {t} en {y}.", "Hablamos con {T} {n} durante {d} minutos.", "Consultas: {m} o {p}.", "Para más datos, {m} o teléfono {p}.", "El pasaporte {i} es de {n}.", "{n} vive en {e} desde {y}.", "{n}, vecino de {e}, no contestó.", "{T} {n}, residente en {e}, no contestó.", "Envíe la carta a {e}.", "El carné {i} figura a nombre de {n}.", "{n}, con casa en {e}, firmó.", "{T} {n}, domiciliada en {e}, firmó.", "Escriba a {m} o llame al {p}.", "Responder a {m}, o al {p}.", "El recibo {i} pertenece a {n}.", "La charla con {T} {n} fue en {t}.", "El paseo con {n} fue en {y}.", "La comida con {n} duró poco.", "La cita con {T} {n} quedó en nada.", "Testigo {n}, oído en {t}.",
)
NEGATIVE = (
    # authors that are only cited
    "{s} ({y}) found that {w} {w} {w}.", "As {s} ({y}) and {s} ({y}) argue, {w} {w} the {w}.", "Unlike {s} ({y}), we {w} the {w}.", "{w} {w} has been doubted ({s} {y}; {s} and {s} {y}).", "This view is older ({s} {y}a, {y}b; see also {s} et al. {y}, pp. {d}-{d}).", "({s}, {y}; {s}, {y}: {d}; cf. {s} & {s} {y})",
    "Van {s} ({y}) and de {s} ({y}) disagree.", "In Mac {s} ({y}) the {w} is a {w}.", "Those who know {s} ({y}) will expect {w} and {w}.", "Mac {s} ({y}a) gives {d} {w}, von {s} ({y}) more.", "Following {s} and {s} ({y}), {w} {w} {w}.", "Neither {s} ({y}) nor Mac {s} ({y}) {w} the {w}.", "By contrast with {s} ({y}), {w} {x} {w} in {t}.", "The {w} {w} {w} (van {s} and {s} {y}; Mac {s} {y}).", "Bei {s} ({y}) heißt das {c}.", "Nach {s} und {s} ({y}) sind {c} und {c} {x}.", "Comme l'écrit {s} ({y}), le {x} {x} la {x}.", "D'après {s} et {s} ({y}), les {x} {x}.", "Selon {s} ({y}), on {x}.", "Selon {s} et {s} ({y}), {x} {x}.", "Según {s} ({y}), se {x}.", "Laut {s} ({y}) {x} man.", "WE {x} THE {x} OF {x} {x}.", "{c} OF THE {c}, {y}", "Como dice {s} ({y}), el {x} {x} la {x}.", "Para {s} y {s} ({y}), los {x} {x}.",
    # institutions, places, books, events
    "The {s} Institute for Rural Studies was founded in {y}.", "The {s} Foundation paid {d4} in {y}.", "The {s} College of {t} closed.", "The {t} Council and the {s} Trust {w} {w}.", "The University of {t} and the {s} Library {w}.", "{s} & Sons of {t} printed {d} {w}.", "It came out with the {t} University Press in {y}.", "The Bank of {t} lent {d4} to the {c} of {c}.", "The Journal of {c} {c} and the {t} {c} are {w}.", "Annual {c} of the {c}, Vol. {d}, No. {d}, pp. {d}-{d}.", "The {c} and {c} {c} met in {t}.", "The {s} Commission and the {s} Act of {y} {w} little.",
    "In {t} and in Upper {t} {w} {w}.", "South {t} had {d4} {w} in {y}.", "From {t} to {t} it is {d} miles.", "Port {t} and New {t} are {w}.", "The market on Bridge Street was {w}.", "The fair in Church Lane drew {d4} {w}.", "A walk along Station Road in {t} takes {d} minutes.", "Oxford Street and High Street {w} first.", "On Monday, {d} May {y}, the {c} opened.", "In March {y} and April {y} {w} {w}.", "Week {d}: read {c} and {c}, chapters {d} and {d}.", "Room {d}, Tuesday {d} to {d}.",
    # numbers that are nobody's
    "Grant {d4}-{d2}-{d4} paid for the {w}.", "Project number {d2}-{d4}/{d2} of the {c}.", "doi 10.{d4}/{x}.{y}.{d4}", "ISSN {d4}-{d4}, doi:10.{d4}/s{d6}-{d3}.", "It has the ISBN 978-{d}-{d4}-{d4}-{d}.", "The call number is {C}{C} {d3}.{d2} {C}{d2}.", "Box {d}, folder {d}, {C}{C} {d2} {d3} {d2}.", "Call mark {C}{C} {d3} {d2} {d2}, vol. {d}.", "Shelf {C}{C} {d3} {d2} {d2}, volume {d}, pp. {d}-{d}.", "Mark {C}{C} {d3} {d2} {d2} in the {c}.", "Signatur {C} {d2} {d3}/{d2}, Blatt {d}.", "Catalogue {d3} {d2} {d4}, plate {d}.", "Order {d6} of {d}/{d}/{y} was {w}.", "Version {d}.{d}.{d4} of the {w}.", "The sample of {d4} persons in {d} {w} ({y}-{y}).", "N = {d4}, r = .{d2}, F({d}, {d3}) = {d2}.{d2}, p < .0{d2}.", "Between {y} and {y}, {d4} of {d4} {w} {w}.", "Prices rose from {d3}.{d2} to {d3}.{d2} between {y} and {y}.", "Volume {d2}({d}), pages {d3}-{d3}.", "Lines {d3}-{d3} and {d4}-{d4} of table {d}.", "The coordinates are {d2}.{d4}, {d2}.{d4}.", "Call {d3} for help, page {d3} for maps.",
    "The account @{x} is that of a {w}.", "Look for @{x} and the {w}.", "Meet at {d} at the {w}.", "We looked at {d} {w} and at {t}.", "Flat {w} and box {w} were {w}.", "The box held {d} {w}.",
    # plain text
    "{w} {w} {w} the {w}, and {w} {w} {w}.", "{c} {w} {w} {x} {w}.", "The {w} of {w} {w}, {w} and {w}.", "It is not the {w} but the {w} that {x} {w}.", "Few {w} {w}; most {x} {w} {w}.", "In {t}, {d} {w} {x} {w}.", "À {t}, {d} {x} {x}.", "À {t}, {d} {x} {x} un {x}.", "En {t}, {d} {x} {x}.", "Zu {t} {x} {d} {c}.", "Von {t} nach {t} {x} {c}.", "At {t}, {w} {w}.", "Près de {t}, {d} {x}.", "Cerca de {t}, {d} {x}.", "{t} is {w} {w} {x}.", "Der {c} der {c} und die {c} {x}.", "Die {c} {x} das {c} in {t}.", "Weder {c} noch {c} {x} den {c}.", "Es {x} die {x} {c}.", "Man {x} den {c} und das {c}.", "So {x} {d} {c} ihre {c}.", "Die {c} {x} den {c}, nicht das {c}.", "Nach {y} {x} die {c} den {c}.", "Zwischen {y} und {y} {x} {d} {c} die {c}.", "Das {c} für {c} in {t} {x}.", "Le {x} et la {x} de {t} {x}.", "En {y}, {d} {x} {x} à {t}.", "Depuis {y}, le {x} {x} les {x}.", "El {x} y la {x} de {t} {x}.", "Desde {y}, {d} {x} {x} en {t}.", "Professor {s} ({y}) {w} it.", "Sir {s} is cited nowhere ({s} {y}).",
)
# Never trained on.
UNSEEN_POSITIVE = (
    "Send the forms to {n}, whose office is at {a}.", "If in doubt, ring {p} or write to {m}.", "The deed names {n} (number {i}) as heir.", "It was {n} who showed us the {w}.", "A postcard from {n} reached us in {t}.", "The keys were left with {T} {n} at {a}.", "Mail for the committee: {m}.", "The nurse copied {i} from the bracelet.", "{n} answered: {w} {w}, then hung up ({p}).",
    "Ihre Nummer {i} steht im Buch; {n} hat es geführt.", "Post geht an {g}.", "Der Anruf kam von {p}.", "La lettre de {n} est partie du {f}.", "Le dossier {i} est perdu.", "La carta de {n} llegó de {e}.", "El número {p} no contesta.",
)
UNSEEN_NEGATIVE = (
    "{s} ({y}) would call this {w}.", "It was said before (see {s} {y}; {s} and {s} {y}).", "The {s} Society and the University of {t} were {w}.", "Award {d4}-{d4} and shelf {C}{C} {d3} {d2} are {w}.", "There were {d4} {w} in {t} in {y}.", "The {c} of {c} {w} in {y}.", "So {w} {w} the {x}, {w} {w}.", "Das {c} und die {c} {x}.",
)
TYPES = {"n": "name", "m": "email", "p": "phone", "i": "id_number", "a": "street_address", "g": "street_address", "f": "street_address", "e": "street_address"}


class _Fillers:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letters(self, low: int, high: int) -> str:
        """A random word of so many syllables."""
        r = self.r
        starts, ends = "b bl br c ch cl d dr f fl fr g gl gr h j k kn l m n p pl pr qu r s sch sh sk sl sp st str t th tr v w z".split(), ("", "", "", "l", "n", "r", "s", "t", "m", "nd", "rk", "ld", "ng", "ck", "x", "ft", "rt")
        return "".join(r.choice(starts) + r.choice("aeiouaeiouy") + r.choice(ends) for _ in range(r.randint(low, high)))

    def family(self) -> str:
        r = self.r
        if r.random() < 0.3:
            return r.choice(FAMILY)
        word = self.letters(2, 4).capitalize()
        return word.replace(r.choice("aou"), r.choice("äöüéáø"), 1) if r.random() < 0.08 else word

    def town(self) -> str:
        r = self.r
        word = self.letters(2, 4).capitalize() + r.choice(("", "", "", "ton", "ham", "ville", "burg", "stadt"))
        return f"{r.choice(('', '', '', '', 'Port-', 'Lower-', 'Bad '))}{word}{r.choice(('', '', '', '', '-on-Sea', '-le-Roi'))}"

    def name(self) -> str:
        r = self.r
        family = self.family()
        if r.random() < 0.14:
            family = r.choice(("van ", "Mac ", "de ", "von ", "van der ")) + family
        if r.random() < 0.05:
            family += f"-{self.family()}"
        given = r.choice(GIVEN) if r.random() < 0.75 else self.letters(1, 3).capitalize()
        middle = f" {r.choice('ABCDEFGHJKLMNPRSTW')}." if r.random() < 0.25 else ""
        x = r.random()
        if x < 0.6:
            return f"{given}{middle} {family}"
        if x < 0.78:
            return f"{family}, {given}{middle}"
        if x < 0.93:
            return f"{r.choice('ABCDEFGHIJKLMNOPQRSTUVWYZ')}.{middle} {family}"
        return f"{family}, {r.choice('ABCDEFGHIJKLMNOPQRSTUVWYZ')}.{middle}"

    def mail(self) -> str:
        r = self.r
        a, b = r.choice(GIVEN).lower(), self.family().lower()
        local = r.choice((f"{a}.{b}", f"{a}-{b}", f"{a[0]}{b}", f"{b}_{a[0]}{self.digits(2)}", f"{b}+{self.letters(1, 2)}", f"{b}{self.digits(2)}", a, f"{a[0]}.{b}"))
        host = r.choice((self.letters(1, 3), f"{self.letters(1, 2)}.{self.letters(1, 3)}", f"{self.letters(1, 2)}-{self.letters(1, 3)}")) + r.choice((".example", ".org", ".net", ".edu", ".com", ".test", ".de", ".fr", ".es", ".ac.uk"))
        x = r.random()
        if x < 0.12:
            return f"{local} @ {host}"
        if x < 0.24:
            return f"{local} (at) {host}"
        if x < 0.36:
            return f"{local} [at] " + host.replace(".", " [dot] ")
        if x < 0.46:
            return f"{local}@{host}".upper() if x < 0.41 else f"{local.title()}@{host}"
        return f"{local}@{host}"

    def phone(self) -> str:
        d = self.digits
        return self.r.choice((
            f"+44 {d(4)} {d(3)} {d(3)}", f"+44 {d(2)} {d(4)} {d(4)}", f"0{d(4)} {d(6)}", f"0{d(2)} {d(4)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"1{d(10)}",
            f"+49 {d(2)} {d(5)} {d(3)}", f"0{d(2)}/{d(5)}-{d(3)}", f"0{d(3)} {d(6)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"{d(3)} {d(3)} {d(3)}", f"07{d(3)} {d(6)}",
        ))

    def identity(self) -> str:
        d, r = self.digits, self.r
        c = lambda n=1: "".join(r.choice("ABCDEFGHJKLMNPQRSTWXYZ") for _ in range(n))
        return r.choice((
            f"{c(2)} {d(2)} {d(2)} {d(2)} {c()}", f"{c(2)}{d(6)}{c()}", f"{c(2)}{d(7)}", f"{c()}{d(8)}{c()}", f"{c()}{d(8)}", f"{d(8)}{c()}", f"{c()}-{d(1)}.{d(3)}.{d(3)}", f"{c()}-{d(2)}.{d(3)}.{d(3)}", f"{d(6)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{d(3)} {d(2)} {d(4)}",
        ))

    def address(self) -> str:
        r, n = self.r, self.r.randint
        street = f"{n(1, 250)}{r.choice(('', '', '', '', 'a', 'B'))} {r.choice(('', '', '', '', 'Old ', 'New ', 'Upper ', 'Great '))}{r.choice(_STREETS) if r.random() < 0.6 else self.letters(1, 3).capitalize()} {r.choice(_KINDS)}"
        town, x = self.town(), r.random()
        if x < 0.16:
            return f"Flat {n(1, 30)}, {street}, {town}"
        if x < 0.34:
            return f"{street}, Apt {n(1, 40)}{r.choice('ABC')}, {town} {self.digits(5)}"
        if x < 0.5:
            return f"{r.choice(('P.O. Box', 'P.O. Box', 'PO Box', 'P. O. Box', 'Box'))} {n(10, 9999)}, {town}"
        return f"{street}, {town}"

    def german(self) -> str:
        r = self.r
        if r.random() < 0.2:
            return f"Postfach {self.digits(r.choice((4, 4, 3)))}, {self.digits(5)} {self.town()}"
        stem = r.choice(_GERMAN) if r.random() < 0.6 else self.letters(1, 3).capitalize()
        return f"{stem}{r.choice(('straße', 'gasse', 'weg', 'straße', 'platz', 'allee', 'strasse'))} {r.randint(1, 250)}, {self.digits(5)} {self.town()}"

    def french(self) -> str:
        r = self.r
        if r.random() < 0.15:
            return f"BP {self.digits(3)}, {self.digits(5)} {self.town()}"
        kind, name = r.choice(("rue", "rue", "avenue", "place", "impasse", "chemin", "boulevard", "quai")), r.choice(_FRENCH) if r.random() < 0.6 else f"{r.choice(('de ', 'du ', 'des '))}{self.letters(1, 3).capitalize()}"
        return f"{r.randint(1, 250)}{r.choice(('', '', ' bis', ' ter'))}, {kind} {name}, {self.digits(5)} {self.town()}"

    def spanish(self) -> str:
        r = self.r
        if r.random() < 0.15:
            return f"Apartado {self.digits(4)}, {self.town()}"
        name = r.choice(_SPANISH) if r.random() < 0.6 else f"{r.choice(('de ', 'del ', 'de la ', ''))}{self.letters(1, 3).capitalize()}"
        return f"{r.choice(('calle', 'Calle', 'avenida', 'plaza', 'C/', 'paseo'))} {name} {r.randint(1, 99)}, {r.choice(('', f'{r.randint(1, 6)}º, '))}{self.digits(5)} {self.town()}"

    def fill(self, code: str) -> str:
        r = self.r
        if code.startswith("d"):
            return self.digits(int(code[1:])) if code[1:] else str(r.randint(1, 400))
        return {
            "n": self.name, "m": self.mail, "p": self.phone, "i": self.identity, "a": self.address, "g": self.german, "f": self.french, "e": self.spanish, "s": self.family, "t": self.town,
            "y": lambda: str(r.randint(1790, 2026)), "c": lambda: r.choice(_CAPITALS) if r.random() < 0.6 else self.letters(2, 3).capitalize(), "C": lambda: r.choice("BDGHKLPQRSTVX"), "T": lambda: r.choice(TITLES),
            "w": lambda: r.choice(_WORDS) if r.random() < 0.7 else self.letters(2, 4), "x": lambda: self.letters(1, 4),
        }[code]()


def labelled_sentences(rounds: int = 12, seed: int = 11, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with their places (start, end, type)."""
    fill, out = _Fillers(seed), []

    def write(pattern: str) -> tuple[str, list[tuple[int, int, str]]]:
        text, places = "", []
        for k, bit in enumerate(re.split(r"\{(\w+)\}", pattern)):
            value = fill.fill(bit) if k % 2 else bit
            if k % 2 and bit in TYPES:
                places.append((len(text), len(text) + len(value), TYPES[bit]))
            text += value
        return text[:1].upper() + text[1:] if not places or places[0][0] else text, places

    for _ in range(rounds):
        for pattern in (*positive, *negative):
            text, places = write(pattern)
            if fill.r.random() < 0.5:  # among other sentences, as in running text
                lead = write(fill.r.choice(negative))[0] + fill.r.choice((" ", " ", "\n", "\n\n"))
                text, places = lead + text, [(a + len(lead), b + len(lead), k) for a, b, k in places]
            if fill.r.random() < 0.7:
                text += fill.r.choice((" ", " ", " ", "\n\n")) + write(fill.r.choice(negative))[0]
            out.append((text, places))
    return out
