"""The labelled table from which the field is trained: sentences with marked slots, and invented values for the slots.

A slot {kind} is filled and labelled with its kind; {x_kind} is filled likewise but is ordinary text, as it stands for
things that only look like personal data. Every fourth sentence is held out of the training and measures it.
"""

from __future__ import annotations

import random

SENTENCES = """
Bitte wenden Sie sich an {name}, Telefon {telefon}.
Am Dienstag hat {name} angerufen und einen Termin verlangt.
Am Freitag rief {name} zurück.
Bitte schreiben Sie {name} oder {name}.
Mit freundlichen Grüssen {name}
Freundliche Grüsse, {name}
Ihre Ansprechpartnerin: {name}
Zuständig ist {name}, erreichbar unter {telefon}.
Sehr geehrte Frau {surname}
Sehr geehrter Herr {surname}, vielen Dank für Ihr Schreiben.
Herr {surname} hat die Rechnung beglichen.
Frau {surname} übernimmt den Kurs ab August.
Frau {surname} und Herr {surname} haben zugesagt.
Der Kurs bei {name} fällt heute aus.
Der Unterricht bei {name} begann pünktlich.
Versicherte Person: {name}, AHV-Nummer {ahv}.
{name} wohnt neu an der {adresse}.
{name} hat die Prüfung bestanden.
{name} und {name} kamen zu spät.
Lieferadresse: {adresse}.
Zustellung bitte an die {adresse}.
Rechnung an {name}, {adresse}.
Kontaktperson {name} ({telefon})
Anmeldung per Mail an {email} bis Freitag.
Schreiben Sie an {email} oder wählen Sie {telefon}.
Patient: {name}, geboren am 3.4.1980.
Patientin: {name}
Teilgenommen haben {name}, {name} sowie {name}.
Mitglieder der Kommission: {name}, {name}, Frau {surname}.
Das Protokoll führte {name}.
Bewilligt durch {name} am 12.3.2019
i. A. {name}
sig. {name}.
Visum: {name}
Die Tante, Frau {surname}, holt den Jungen ab.
Vertreten durch Rechtsanwalt {name}.
Lehrerin: {name}.
Schulleiter {name}, Telefon {telefon}
Das Mädchen lebt bei {name} an der {adresse}.
Eltern: {name} und {name}.
Familie {surname}, {adresse}
Die Familie {surname} zieht im Mai um.
Fam. {surname} bezahlt bar.
Absender: {name}, {adresse}
Herr Dr. {surname} untersuchte das Knie.
Frau Prof. {surname} hält den Vortrag.
Dr. med. {name} stellte das Zeugnis aus.
Beistand ist {name}, erreichbar über {email}.
Grossvater {name} unterschrieb das Formular.
Kopien gehen an {name}; die Akte liegt bei {name}.
In Absprache mit {name} wurde die Lektion verschoben.
Wie {name} mitteilte, war die Türe offen.
Laut {name} stimmt der Saldo.
Wir haben {name} um Auskunft gebeten.
Das Gesuch von {name} ist eingegangen.
Zum Vorstand gehört neu auch {name}, {adresse}.
Unterzeichnet: {name} / {name}
Verantwortlich: {short} (Büro), Telefon {telefon}
Auskunft: {short}, intern {telefon}
Betreuung {short} Mobile {telefon}
Gemäss {short} ist alles in Ordnung.
Wohnort: {adresse}
Umzug nach {adresse} per Ende Monat.
Treffpunkt ist {adresse} um neun Uhr.
Sie wohnt {adresse}, im dritten Stock.
Der Vater wohnt an der {adresse}, die Mutter {adresse}.
Die Praxis liegt neu {adresse}.
Abgabe bei {adresse}, Hintereingang.
Nummer der Sozialversicherung: {ahv}
Vers.-Nr. {ahv} und Name {name} stimmen überein.
Auf dem Ausweis steht {ahv}.
Ausweis {ahv}, ausgestellt in Bern.
Die Nummer {ahv} gehört dem Kind.
Bei Fragen: {email}
{email} gilt ab sofort.
Unsere Adresse im Netz lautet {email}.
Mobil {telefon}, privat {telefon}.
Tel. {telefon} oder Fax {telefon}
Die Nummer {telefon} ist besetzt.
Im Notfall bitte {telefon} wählen, danach {email}.
Rückruf an {telefon}.
Veuillez contacter {name} au {telefon}.
Madame {surname} vous attend à dix heures.
Monsieur {name} habite {adresse}.
Mme {surname} répondra par {email}.
Élève : {name}
Parents : {name} et {name}
Adresse : {adresse}
Lu et approuvé, {name}
Monsieur {surname} est absent, appelez le {telefon}.
Contact : {name}, portable {telefon}
Persona di riferimento: {name}, telefono {telefon}
La signora {surname} ha chiamato ieri.
Signor {surname} abita in {adresse}.
Indirizzo: {adresse}
Distinti saluti {name}
Please call {name} at {telefon}.
Dear Mr {surname}, thank you for your letter.
Kind regards, {name}
Mail to {email}, please.
Die Firma {x_surname} AG liefert am Mittwoch.
Die Stiftung {x_surname} trägt die Kosten.
Bei der {x_surname} & Partner GmbH fehlt die Rechnung.
Das Hotel {x_surname} ist ausgebucht.
Der Verein {x_surname} sammelt Altpapier.
Im Restaurant {x_surname} gab es Suppe.
Die Garage {x_surname} & Cie. prüft den Wagen.
Die Metzgerei {x_surname} schliesst.
Die {x_surname} Immobilien AG verwaltet das Haus.
Konditorei {x_surname} GmbH, Filiale West
Offerte der {x_surname} Holding SA vom Montag
Die Haltestelle {x_street} wird verlegt.
Der {x_street} bleibt bis Freitag gesperrt.
Am {x_street} wird gebaut.
Auf der {x_street} hat es Schnee.
Im Quartier {x_street} entsteht ein Park.
Beim {x_street} treffen sich alle 20 Kinder.
Das Buch {x_street} hat 240 Seiten.
Auftrag {x_number} wurde am 4.5.2017 erledigt.
Beleg {x_number}/12 vom 30.11.2020 fehlt.
Referenz {x_number} bitte angeben.
Programmversion 7.12.30 erscheint am 1.9.2018.
Der Schnitt beträgt 4.8, die Bestnote 5.5.
Gruppe @Team7 trifft sich um 14.15 Uhr in Zimmer 11.
Bestellnummer {x_number}, Menge 40 Stück.
Die {x_noun} wurde um 8 Uhr eröffnet.
Der {x_noun} zeigt grosse Fortschritte in {x_noun}.
In {x_noun} und {x_noun} fehlt die Übung.
Für {x_noun} sowie {x_noun} bleibt wenig Zeit.
Das Thema {x_noun} wird mit der {x_noun} verbunden.
Ohne {x_noun} wäre die {x_noun} nicht möglich, wie der {x_noun} zeigt.
Im Fach {x_noun} arbeitet das Kind sorgfältig, in {x_noun} eher flüchtig.
Die {x_noun} der {x_noun} liest gerne laut vor.
Zur {x_noun} gehört ein {x_noun} mit Bildern.
Unter {x_noun} sind drei Einträge zu finden.
Während der {x_noun} hilft der Junge den Kleinen.
{x_noun} und {x_noun} sind abgeschlossen.
{x_noun}: {x_noun}
Nach der {x_noun} folgt die {x_noun}.
Gemeinde {x_town} {x_noun} 2021
Die Gemeinde {x_town} lädt ein.
{x_noun} {x_town}, Klasse 6a, Semester 1
Seite 3 von 7
VERTRAULICHE {x_noun} DER {x_noun}
Im Januar, Februar und März fällt der Kurs aus.
Die Zusammenarbeit mit den Behörden war freundlich und klar.
Deutsch, Englisch, Französisch und Mathematik wurden geprüft.
Mündlich beteiligt sich die Schülerin oft und mit guten Ideen.
Le rapport annuel est disponible à la mairie.
Il bambino legge bene e scrive volentieri.
The annual report lists all open invoices.
Das alte Auto steht noch in der Halle.
Die Heizung läuft, die Fenster sind zu.
Vor den Sommerferien wird der Ordner abgegeben.
Der Schwimm- und Turnkurs beginnt neu am Abend.
""".strip().splitlines()

# Patterns of a sentence without words of its own: ordinary words around personal data and around what is none.
PATTERNS = """
{x_begin} {x_low} {name} {x_low} {x_low}.
{x_low} {x_noun} {x_low} {name}, {x_low} {x_low} {x_noun}.
{x_begin} {x_noun} {x_low} {name}.
{name} {x_low} {x_low} {x_noun}.
{x_noun}: {name}
{x_noun}: {name}.
{x_noun} {x_low} {name} {x_low} {x_low}.
{x_low} {name} {x_low} {x_begin} {x_noun}
{x_noun} {name}, {adresse}.
{x_noun} {x_low} {name} {x_low} {adresse}
{x_noun}: {name}, {name} {x_low} {x_title} {surname}
{x_title} {surname} {x_low} {x_low} {x_noun}.
{x_title} {surname} {x_low} {telefon}
{x_begin} {x_low} {x_title} {surname}, {x_low} {x_low}.
{x_title} {name} {x_low} {x_noun}
{x_noun} {short} ({x_noun}), {x_noun} {telefon}
{x_noun} {x_low} {short} {x_low} {x_low}.
{x_noun}: {short}
{x_noun} {telefon}
{x_noun}: {telefon}
{x_low} {x_noun} {telefon} {x_low}, {x_low} {email}.
{x_noun} {telefon}, {x_noun} {telefon}.
{x_low} {x_low} {telefon}.
{x_begin} {x_noun} {x_low} {x_low} {email}
{email} {x_low} {x_low} {x_noun}.
{x_noun}: {email}
{x_noun} {x_low} {email}.
{x_noun}-Nr. {ahv}, {x_low} {adresse}.
{x_noun} {ahv} {x_low} {x_low} {x_noun}.
{x_begin} {x_noun} {x_low} {ahv}.
{x_noun}. {ahv} {x_low} {x_noun} {name}.
{x_noun} Nr. {ahv} {x_low} {x_low}.
{x_begin} {x_noun} {x_low} {x_low} {adresse}.
{x_low} {x_noun} {adresse}.
{x_noun}: {adresse}.
{x_noun} {x_low} {adresse} {x_low}.
{x_low} {x_low} {adresse}, {x_noun}.
{x_begin} {x_noun} {x_low} {x_low} {x_adjective}, {x_low} {x_low} {x_noun} {x_noun}.
{x_begin} {x_noun} {x_low} {x_noun} {x_low} {x_low} {x_noun}, {x_low} {x_low}.
{x_low} {x_noun} {x_low} {x_noun} {x_low} {x_low} {x_adjective} {x_noun}.
{x_low} {x_noun} {x_noun} {x_low} {x_begin} {x_noun}.
{x_noun} {x_low} {x_noun} {x_low} {x_noun}.
{x_begin} {x_adjective} {x_noun} {x_low} {x_low} {x_noun} {x_low} {x_noun}-{x_noun}.
{x_noun}- {x_low} {x_noun} {x_low} {x_low} {x_noun}
{x_noun} {x_town}
{x_shout} {x_shout_town}
{x_noun} {x_area}
{x_noun} {x_area}, {x_noun} {x_low} {x_noun}
{x_noun} {x_town} {x_noun} {x_area}
{x_low} {x_noun} {x_low} {x_noun}, {x_low} {x_begin} {x_noun}-{x_noun} {x_low}.
{x_begin} {x_noun} {x_low} {x_noun} {x_adjective}, {x_low} {x_low} {x_low} {x_noun} {x_noun}.
{x_shout} {x_shout_town} – {x_shout}
{x_noun}, {x_noun} 3, {x_noun} {x_town}
{x_noun} 4b {x_town} / {x_noun} 2b
{x_begin} {x_noun} {x_surname} {x_low} {x_low}.
{x_begin} {x_org} {x_surname} {x_low} {x_low} {x_noun}.
{x_begin} {x_org} {x_surname} & {x_noun} GmbH {x_low} {x_low}.
{x_begin} {x_surname} {x_org} AG {x_low} {x_low} {x_noun}.
{x_begin} {x_noun} {x_low} {x_street} {x_low}.
{x_low} {x_street} {x_low} {x_begin} {x_noun} {x_low}.
{x_noun} {x_number} {x_low} {x_noun} {x_number} {x_low} {x_low}.
{x_noun} 4.5 {x_low} {x_noun} 5.3.
""".strip().splitlines()
#: How often the patterns stand in the table for each time the sentences do.
REPEATS = 3

# Common given names of several languages, as fillings only: the field knows no list of names.
_GIVEN = """
Adrian Aisha Alain Albert Alessandro Alexandra Alfred Alice Amélie Ana Andrea Andreas Angela Anita Anna Antonio Arthur Beat Beatrice Benjamin
Bernhard Bettina Bruno Camille Carla Carmen Caroline Chiara Christa Christoph Clara Claudia Daniel David Denise Dominik Doris Edith Elena Elias
Emil Emma Erika Ernst Esther Eva Fabian Fatima Felix Filippo Florian François Franziska Frieda Gertrud Giulia Gregor Hanna Harald Hedwig Heinz
Helena Helga Herbert Hugo Ida Ines Irene Isabelle Ivan Jana Jean Jeannette Joel Jonas Josef Judith Julia Julien Jürg Karin Karl Katja Kevin Klara
Konrad Kurt Lara Laura Lea Lena Liam Lina Linus Livia Louis Luca Lucia Ludwig Luis Lukas Manuel Marco Maria Marianne Mario Markus Martin Martina
Mathilde Matteo Maurice Max Melanie Michael Michel Mila Mohamed Monika Nadia Nathalie Nico Nicole Nina Noah Nora Olga Oliver Olivia Otto Pascal
Patrick Paul Peter Petra Philipp Pierre Rahel Ralf Regula Reto Rita Robert Roland Romy Ruth Sabine Samuel Sandra Sara Silvia Simon Sofia Sonja
Sophie Stefan Stefanie Sven Tanja Thomas Tim Tobias Ursula Vera Viktor Vincent Vivienne Werner Yvonne Yusuf
""".split()
_GIVEN_END = "a ina ine ette elle ia ie us an in ert ard bert olf as on ald frid hild trud mar ber fried eas ikus i li eli y o io ana ena ias".split()
# Usual beginnings and ends of surnames, words and towns, from which fillings are made.
_FRONT = "Alten Amberg Asch Bach Baum Brand Breiten Burg Dorn Eck Eisen Fisch Frisch Gold Graben Hag Hart Heim Hell Hinter Holz Imhof Kalt Klein Kohl Lauter Lichten Loh Lutz Mühl Nieder Oden Ost Rappen Rein Rot Rüti Schön Schwarz Seiler Spitz Stadel Strub Tal Ur Vogel Wank Wart Wasser Wil Win Zim".split()
_BACK = "acker ammann auer bach bauer berg berger brunner bühler dorfer egger eler eli ener er feld felder gasser graf haus hauser heim hofer huber i in inger ler li lin mann maier matt matter meier mer müller ner rer reuter ried riss schmid ser ski stein steiner stetter ter thaler wald walder wanner wyler zer zinger binder brugger decker fellner gruber hofner kofler kramer lechner leitner ling lauer macher moser pichler richter rieder scheider singer steger wart weber wieser wiler zeller li tli mattli".split()
_WHOLE = "Meier Müller Schmid Keller Weber Huber Frei Moser Gerber Wyss Graf Baumann Zimmermann Rossi Bianchi Ferrari Bernasconi Favre Rochat Dubois Martin Nguyen Khan Nowak Kowalski Silva Santos Garcia Odermatt Zgraggen Brunner Kaya Yilmaz Petrovic Jovanovic Smith Jones Taylor O'Connor Di Marco Meyer Roth Bucher Suter Kunz Hess Amstutz Aebi Zbinden Zürcher Fankhauser Gasser Imboden Inderbitzin".replace(" ", "").split()
_STREETS = "Alpen Birken Blumen Brunn Buchen Burg Dorn Eichen Feld Fluss Forst Gewerbe Grün Hafen Heide Industrie Kloster Markt Mittel Nord Obst Park Quell Rosen Schloss Schützen See Seefeld Spital Stadt Süd Tal Turm Ufer Wald Wasser Weid West Ziegel Zoll".split()
_KINDS = "strasse strasse weg weg gasse platz rain halde allee quai ring steig hof matte promenade".split()
_PLACES = "Im Grund;Im Winkel;Am Bach;Am Rain;Auf der Höhe;Hinter der Kirche;Obere Gasse;Unterer Weg;Alte Landstrasse;Neue Strasse;Langer Weg;Grosse Allee".split(";")
_FOREIGN = "rue de {w};rue du {w};rue {w};avenue de {w};avenue du {w};chemin de {w};chemin du {w};route de {w};place du {w};quai de {w};boulevard {w};ruelle des {w};via {w};via al {w};via della {w};viale {w};vicolo {w};piazza {w}".split(";")
_FOREIGN_WORDS = "Lausanne Berne Lac Marché Temple Soleil Forêt Église Château Pont Moulin Rivière Jardin Gare Nord Midi Vignes Alpes Roma Ponte Chiesa Castello Fiume Monte Sole Ticino Scuola Giardino Rossa Nuova Maggio".split()
_TOWN_FRONT = "Alt Am Birs Brig Burg Dör Eng Gold Hag Heim Kalt Kirch Lies Mühl Nider Ober Rhein Rüti Schön See Sonn Stein Thal Uns Wald Win Zof".split()
_TOWN_BACK = "au ach bach berg brugg burg dorf egg felden furt hausen heim hofen ikon ingen kirch matt ried stetten tal wil wald".split()
_TOWNS = "Bern Zürich Basel Genève Lausanne Lugano Luzern Chur Thun Biel Aarau Olten Sion Fribourg Bellinzona Zug".split()
_NOUN_FRONT = "Abend Arbeits Auto Bau Bild Brief Daten Eltern Farb Ferien Film Garten Haus Heft Jahres Kinder Kunst Land Lern Lese Markt Musik Natur Pausen Preis Rechen Reise Sach Schul Sprach Spiel Sport Tages Tier Verkehrs Wald Wetter Wochen Werk Zeit Zahlen".split()
_NOUN_BACK = "abend arbeit auftrag beitrag bericht besuch buch eindruck ende fest gespräch gruppe heft karte kasse klasse kunde lager leitung liste mappe ordnung pause plan programm projekt prüfung raum reise sammlung stunde tag tafel thema übung unterricht verein vertrag vorstellung woche wissen zettel ziel zimmer".split()
_NOUNS = "Geschichte Geografie Physik Schwimmen Werken Zeichnen Turnen Ausdauer Freude Verhalten Absenzen Leistung Aufgabe Lehrperson Mutter Vater Schüler Schülerin Klasse Semester Montag Januar Bern Protokoll Saldo Versicherung Kopie Unterlagen Adresse Telefon Nummer Notfall Kind Kinder Konto Konflikt Konzentration Vertrauen Mathematik Kontakt Rechnung Beurteilung Sekretariat Hausrat".split()


def _surname(r: random.Random) -> str:
    def one() -> str:
        roll = r.random()
        if roll < 0.25:
            return r.choice(_WHOLE)
        name = r.choice(_FRONT) + r.choice(_BACK)
        return name.replace("ae", "ä") if roll < 0.9 else name.replace("ü", "ue").replace("ä", "ae").replace("ö", "oe")

    name, roll = one(), r.random()
    return f"{name}-{one()}" if roll < 0.12 else f"{r.choice(['von', 'de', 'van', 'von', 'di'])} {name}" if roll < 0.18 else name


def _first(r: random.Random) -> str:
    def one() -> str:
        if r.random() < 0.6:
            return r.choice(_GIVEN)
        return (r.choice("BCDFGHJKLMNPRSTVWZ") + r.choice("aeiouöä") + r.choice(["", "r", "l", "n", "s", "tt", "ll"]) + r.choice(["", "d", "b", "m", "st", "th", "k"]) + r.choice(_GIVEN_END)).capitalize()

    return f"{one()}-{one()}" if r.random() < 0.08 else one()


def _name(r: random.Random) -> str:
    first, last, roll = _first(r), _surname(r), r.random()
    if roll < 0.2:
        return f"{last} {first}"
    if roll < 0.3:
        return f"{last}, {first}"
    if roll < 0.38:
        return f"{last.upper()} {first}"
    if roll < 0.52:
        return f"{first} {r.choice('ABCDEFGHIJKLMNOPRSTUVWZ')}. {last}"
    if roll < 0.58:
        return f"{first[0]}. {last}"
    return f"{first} {last}"


def _phone(r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    area = r.choice(["21", "22", "31", "32", "41", "44", "52", "61", "62", "71", "76", "78", "79", "81", "91"])
    a, b, c = d(3), d(2), d(2)
    return r.choice([f"0{area}{a}{b}{c}", f"0{area} {a} {b} {c}", f"0{area}/{a} {b} {c}", f"(0{area}) {a} {b} {c}", f"0{area}-{a}.{b}.{c}", f"0{area}.{a}.{b}.{c}", f"+41 {area} {a} {b} {c}", f"+41{area}{a}{b}{c}", f"+41(0){area}-{a}-{b}-{c}", f"0041 (0){area} {a} {b} {c}"])


def _mail(r: random.Random) -> str:
    plain = lambda x: x.lower().replace("ü", "ue").replace("ä", "ae").replace("ö", "oe").replace("é", "e").replace("ç", "c").replace("'", "").replace(" ", "").split("-")[0]
    s, f = plain(_surname(r)), plain(_first(r))
    user = r.choice([f"{f}.{s}", f"{f[0]}.{s}", f"{s}+{r.choice(['post', 'kurs', 'news'])}", f"{f}_{s}{r.randint(10, 99)}", s, "kanzlei", f"gruppe{r.randint(1, 9)}{r.choice('abc')}", "office"])
    host = plain(r.choice(_TOWN_FRONT) + r.choice(_TOWN_BACK))
    host = r.choice([host, f"verein-{host}", f"mail.{host}", f"post.{host}", f"{host}-online"]) + r.choice([".example", ".test", ".invalid", ".ch", ".org"])
    at = r.choice(["@"] * 6 + ["(at)", " [at] ", "[at]", " (at) "])
    text = user + at + host
    return text.upper() if r.random() < 0.08 else text


def _ahv(r: random.Random) -> str:
    d = "".join(r.choice("0123456789") for _ in range(10))
    return r.choice([f"756.{d[:4]}.{d[4:8]}.{d[8:]}", f"756 {d[:4]} {d[4:8]} {d[8:]}", f"756{d}"])


def _town(r: random.Random) -> str:
    return r.choice(_TOWNS) if r.random() < 0.3 else r.choice(_TOWN_FRONT) + r.choice(_TOWN_BACK)


def _street(r: random.Random) -> str:
    return r.choice(_STREETS) + r.choice(_KINDS) if r.random() < 0.85 else r.choice(_PLACES)


def _address(r: random.Random) -> str:
    number = f"{r.randint(1, 140)}{r.choice(['', '', '', 'a', 'b', 'C'])}"
    if r.random() < 0.3:
        street = r.choice(_FOREIGN).format(w=r.choice(_FOREIGN_WORDS))
        text = f"{number}{r.choice([' ', ', '])}{street}" if r.random() < 0.25 else f"{street} {number}"
    else:
        text = f"{_street(r)} {number}"
    return text + f"{r.choice([', ', ', ', ' in '])}{r.choice(['', '', 'CH-'])}{r.randint(1000, 9700)} {_town(r)}" if r.random() < 0.5 else text


def _noun(r: random.Random) -> str:
    return r.choice(_NOUNS) if r.random() < 0.35 else r.choice(_NOUN_FRONT) + r.choice(_NOUN_BACK)


_LOW = "aber ab als an auf aus bei beim bis da dann das dem den der des die durch ein eine einen er es für gegen gerne gut hat hatte heute hier ihr im immer in ist jetzt kann kein kommt lernt liegt macht mehr mit muss nach neu nicht noch nun oder oft ohne schon sehr seit sich sie sind soll sowie steht trägt um und unter vom von vor war weil wenn wie wird wurde wurden zeigt zu zum zur zwei wohnt arbeitet bittet bittet dankt fehlt findet gehört gibt hilft informiert meldet plant schreibt spricht unterstützt verlangt wartet et est pour avec au dans il la le con per nel the and for with".split()
_BEGIN = "Die Das Der Ein Eine Im In Am An Auf Bei Beim Mit Nach Ohne Für Zum Zur Wir Sie Es Wie Als Vor Unter Dem Den Wegen Während".split()
_TITLE = "Frau Herr Familie Madame Monsieur Signora Signor Mme Mr Mrs".split()
_ADJECTIVE = "gut klar neu alt sauber ruhig laut freundlich langsam genau selten deutlich grosser kleine neues wichtige frohe schöner ganzes".split()
_ORG = "Stiftung Verein Garage Firma Restaurant Bäckerei Hotel Treuhand Metzgerei Genossenschaft Apotheke Druckerei Kanzlei Praxis Gärtnerei Bank Versicherung Verlag".split()


FILL = {
    "x_low": lambda r: r.choice(_LOW),
    "x_begin": lambda r: r.choice(_BEGIN),
    "x_title": lambda r: r.choice(_TITLE),
    "x_adjective": lambda r: r.choice(_ADJECTIVE),
    "x_org": lambda r: r.choice(_ORG),
    "x_area": lambda r: r.choice(_STREETS),
    "x_shout": lambda r: _noun(r).upper(),
    "x_shout_town": lambda r: _town(r).upper(),
    "name": _name,
    "surname": _surname,
    "short": lambda r: f"{_first(r)[0]}. {_surname(r)}",
    "email": _mail,
    "telefon": _phone,
    "ahv": _ahv,
    "adresse": _address,
    "x_surname": lambda r: r.choice(_WHOLE) if r.random() < 0.3 else r.choice(_FRONT) + r.choice(_BACK),
    "x_street": _street,
    "x_number": lambda r: f"{r.randint(100, 999)}.{r.randint(0, 99):03d}.{r.randint(0, 99):02d}.{r.randint(0, 99):02d}",
    "x_noun": _noun,
    "x_town": _town,
}
LABEL = {"name": "name", "surname": "name", "short": "name", "email": "email", "telefon": "telefon", "ahv": "ahv", "adresse": "adresse"}


def split(held_out: bool) -> list[str]:
    """The sentences to train from, or those held out."""
    return [s for i, s in enumerate(SENTENCES) if (i % 4 == 3) == held_out]


def labelled(copies: int, seed: int = 11, held_out: bool | None = False) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans with their kind): pieces of one to three sentences, filled with other values each time; of all
    sentences where ``held_out`` is None."""
    r = random.Random(seed)
    out = []
    for _ in range(copies):
        order = list(SENTENCES) if held_out is None else split(held_out)
        order += [] if held_out else PATTERNS * REPEATS
        r.shuffle(order)
        while order:
            text, spans = "", []
            for s in [order.pop() for _ in range(min(len(order), r.choice([1, 2, 2, 3])))]:
                if text:
                    text += r.choice([" ", " ", "\n"])
                for part in s.replace("}", "{").split("{"):
                    if part in FILL:
                        value = FILL[part](r)
                        if part in LABEL:
                            spans.append((len(text), len(text) + len(value), LABEL[part]))
                        text += value
                    else:
                        text += part
            if r.random() < 0.25:
                text = "".join("\n" if c == " " and r.random() < 0.15 else c for c in text)
            out.append((text, spans))
    return out
