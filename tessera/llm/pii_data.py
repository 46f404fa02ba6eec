"""Labelled spans for the personal-information tagger.

Sentences, records and letters with made-up names, numbers and addresses, whose place is known, are mixed with text
that holds none.  Names come from lists of common names of many countries and, for the larger part, from endings
and syllables, so that no list of names can be learnt; numbers follow the formats that countries publish.  The text
without personal information is made up as well or, when training is given folders, comes from lines of source
code, documents and comments in them that nothing makes look personal.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

# Common given names.
GIVEN = """James Mary Robert Patricia Michael Jennifer David Linda William Elizabeth Richard Susan Joseph Jessica Thomas Sarah Daniel Karen Matthew Nancy Anthony Lisa Mark Sandra Steven Emily
Andrew Donna Kevin Michelle Brian Laura George Rebecca Timothy Helen Hans Klaus Stefan Sabine Ursula Monika Wolfgang Heike Uwe Jörg Günther Katrin Pierre Jean François Sylvie Nathalie Benoît Chloé Amélie
Thierry Carlos José Luis Carmen Pilar Javier Lucía Álvaro Raúl Elena João Tiago Rui Catarina Gonçalo Giulia Luca Marco Francesca Alessandro Agnieszka Krzysztof Piotr Katarzyna Lars Ingrid Bjørn Astrid Erik
Kirsten Joost Sanne Daan Femke Mehmet Elif Ahmed Omar Layla Hassan Youssef Priya Arjun Sanjay Deepa Rahul Ananya Wei Li Xin Jing Hao Haruto Sakura Kenji Akiko Hiroshi Min-jun Ji-woo Chidi Amara Kofi Zainab
Tendai Dmitri Svetlana Ivan Natalia Sergei Siobhán Niamh Liam Zoltán Eszter Nikos Eleni Răzvan Ioana Oksana Aino Mikko Tunde Ngozi Mei-Ling Tariq Noor Leila Jacques Margaux""".split()
# Common family names.
FAMILY = """Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Baker
Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Schäfer Dubois Moreau Laurent Lefèvre Girard Rousseau Fournier García
Rodríguez Martínez López Sánchez Fernández Jiménez Silva Santos Oliveira Pereira Costa Rossi Russo Ferrari Esposito Bianchi Kowalski Nowak Zieliński Hansen Johansen Nilsson Lindqvist Andersen de Jong Bakker Visser
Yılmaz Demir Khan Hussain Haddad Patel Sharma Singh Gupta Reddy Iyer Wang Zhang Chen Liu Huang Tanaka Suzuki Yamamoto Kim Park Choi Nguyen Tran Okafor Mensah Abubakar Moyo Ivanov Petrova Volkov Shevchenko
O'Brien McCarthy MacLeod Nagy Szabó Papadopoulos Popescu Virtanen Korhonen Adeyemi Osei""".split()
# Endings of given names.
FIRST_ENDINGS = """bert win ald ard old elius ius ella ina lyn dith trix ette mund fred rick anna isa ora aldo enzo slav mira bella wen line phine lda ence ance ord er en as is us ias iel eus o a e ia io rd rt ric ney son ly cia tta nda rine lia
topher ander aine oise ique edad acio elmo ilde wig hild gard mar rich dolf helm linde bor vit ek ka shka ito iko umi ori eji ru sha esh endra deep jit ullah eem ouf iya ani eka ola ade emi nwe zi""".split()
# Endings of family names, and parts of street names.
ENDINGS = """ton ley field well man son ford wood ham worth mann berger stein hoff bach meier ler stra sma huis veld eau ault ier ard et ois ez era illo ales es inho ini elli etti ozzi ucci ski czyk wicz ak ov ova
enko in ina sson sen ström qvist lund gård nen moto mura yama naka da wal nath escu eanu opoulos idis kwe nde oğlu maz váry ic vić sky""".split()
TREES = """Maple Cedar Willow Birch Church Station Victoria Park Lake River Spring Sunset Washington Lincoln Franklin Jefferson Chestnut Market Bridge Queen King Prince Orchard Meadow Garden Forest Valley Harbour
Linden Rosen Schiller Goethe Bahnhof Haupt Kirch Wald Berg Mozart Beethoven Garten Schul Markt République Victor Hugo Voltaire Pasteur Gambetta Liberté Goya Cervantes Mayor Colón Alameda Augusta Liberdade Flores
Garibaldi Mazzini Dante Roma Verdi Keizers Prinsen Dorp""".split()
WAYS = "Street St. St Road Rd Rd. Avenue Ave Ave. Lane Ln Drive Dr Court Ct Place Pl Square Boulevard Blvd Way Terrace Close Crescent Parkway Hill Row Grove Gardens Walk Mews Highway".split()
TLD = "com org net io de fr es pt it nl co.uk edu gov info eu ch at se pl jp in com.br dev app test invalid example".split()

# Words for sentences, in five languages: things, what is done to them, how they are and were treated.
THINGS = """service server invoice report module parser dashboard pipeline cluster release build page form printer laptop contract order parcel payment meeting review ticket branch config cache log database backup
script widget driver license account signal thread socket buffer request response header token session window button layout theme menu chart folder test patch commit index query key list row column file
table matrix rule plugin filter stream job batch worker node network proxy schema field method class function loop event handler""".split()
DOES = "check update restart review deliver cancel print sign rename archive approve reject test deploy fix move copy send open close read write parse load store merge split sort remove add run stop start build".split()
DONE = "queued written dropped skipped loaded merged rejected accepted closed opened asked confirmed reported drafted signed moved called shipped tested approved restored indexed deleted copied printed sent returned stored requested noticed fixed passed failed".split()
HOW = "slow empty broken ready late missing new old stable local remote shared invalid duplicate partial frozen green red blue small large cold hidden pending unknown optional".split()
LOCAL = {
    "de": ("Rechnung Server Bericht Drucker Vertrag Auftrag Lieferung Zahlung Termin Ordner Datei Abfrage Seite Fehler Version Tabelle Konto Netz Schlüssel Zeile".split(), "langsam leer kaputt fertig fehlt neu alt stabil gesperrt bekannt ungültig da weg".split(), "der die das ein eine dieser im beim mit nach nicht noch wieder bitte heute ist wird wurde hat".split()),
    "fr": ("facture serveur rapport imprimante contrat commande livraison paiement dossier fichier requête page erreur version table compte réseau clé ligne".split(), "lent vide cassé prêt absent nouveau ancien stable bloqué connu invalide".split(), "le la les un une ce cette dans avec pour sur ne pas encore est sera a été".split()),
    "es": ("factura servidor informe impresora contrato pedido entrega pago carpeta archivo consulta página error versión tabla cuenta red clave línea rama".split(), "lento vacío roto listo falta nuevo viejo estable bloqueado conocido inválido".split(), "el la los un una este esta en con para por no todavía es está fue ha".split()),
    "pt": ("fatura servidor relatório impressora contrato pedido entrega pagamento pasta arquivo consulta página erro versão tabela conta rede chave linha painel".split(), "lento vazio quebrado pronto falta novo antigo estável bloqueado conhecido inválido".split(), "o a os um uma este esta em com para por não ainda é está foi tem".split()),
}

# Frames; N name, E email, P phone, I identity number, A street address, K city with postcode, w thing, v deed, s state, 9 number, f path, d date, t title.
FRAMES = """
{t} {N} will {v} the {w} tomorrow.|I spoke with {N} yesterday about the {w}.|Please ask {N} to {v} it.|{N} and {N} are both on leave.|Thanks, {N}!|Hi {N},|Dear {t} {N},|Hello {N}, could you {v} the {w}?|according to {N} the {w} is {s}
{N} wrote:|{N} said that the {w} is {s}.|{N} joined the call from {A}.|approved by {N} on {d}|Meeting with {N} and {N} at {9}|assigned to {N}|cc: {N}, {N}|{N} ({E})|{N} <{E}>|"{N}" <{E}>|{N}, {P}|{N} - {P} - {E}|{N}; {E}; {P}
My name is {N} and I live at {A}.|You can call me on {P}.|My number is {P}, ask for {N}.|Phone {P} or mail {E}.|Tel: {P}|Fax {P}|T {P}|Mobile: {P}|call {P} after {9}|ring {P} if the {w} is {s}|or dial {P}|WhatsApp {P}|reach us on {P} or {P}
Mail me: {E}|send the {w} to {E}|for help, contact {E}.|Write to {E} or {E}|reply to {E} by {d}|from {E} to {E}|bounced: {E}|subscribed {E}|unsubscribe {E}|{E} could not be delivered|user {E} not found|login failed for {E}|invite {E} to the {w}
her social security number is {I}|SSN {I}|SSN: {I}|passport number {I}|passport no. {I} expires {d}|My tax ID is {I}.|national insurance number {I}|ID card {I}|NI no {I}|personal number {I}|driver's tax number: {I}|the customer's passport ({I}) was {s}
found {I} (a social security number) in the {w}|please mask the passport {I} in {f}|leak: national id {I}|identity number {I} belongs to {N}|{N}, passport {I}, {A}|{N} (SSN {I})|applicant {N}, born {d}, id {I}|taxpayer {I}|tax no. {I}|insured under {I}
deliver to {A}|Send the parcel to {A}, {K}.|Our office is at {A}, {K}.|{N}, {A}, {K}|I moved to {A} last week.|pick it up at {A}|the {w} at {A} is {s}|visit {A} on {d}|lives at {A}|Address: {A}|shipping address {A}, {K}|from {A} to {A}|located at {A}.
Signed-off-by: {N} <{E}>|Reviewed-by: {N} <{E}>|Co-authored-by: {N} <{E}>|Reported-by: {N}|Tested-by: {N}|Acked-by: {N}|Suggested-by: {N} <{E}>|Helped-by: {N}|Cc: {N} <{E}>|@author {N}|@author {N} <{E}>|Author: {N}|Author: {N} <{E}>|Written by {N}
Copyright (C) {9} {N}|Copyright 2019 {N} <{E}>|(c) 2021 {N}|Maintained by {N} <{E}>|Contributed by {N}.|Original author: {N}|TODO({N}): {v} the {w}|FIXME: ask {N}|see the mail from {N} of {d}|patch by {N}|found by {N} while testing|Maintainer: {N}
Frau {N} hat angerufen.|Herr {N} kommt am {d}.|Bitte {N} anrufen: {P}|Gruß, {N}|Mit freundlichen Grüßen {N}|Ich wohne {A}, {K}.|Wohnhaft in {A}, {K}|Lieferung an {N}, {A}|Steuernummer {I}|Personalausweis {I}|Reisepass Nr. {I}|Tel. {P}|Mail an {E} genügt.|{N} prüft das noch.
Die Steuer-ID lautet {I}.|Ansprechpartner ist {N} ({P}).|erreichbar unter {P}|laut {N} ist der Server weg|Das hat {N} gemeldet.|Mme {N} a appelé.|M. {N} viendra le {d}.|Bonjour {N},|Merci de contacter {N} au {P}.|Livrer à {N}, {A}, {K}|J'habite {A}.|Numéro de sécurité sociale : {I}
Passeport n° {I}|carte d'identité {I}|écrivez à {E}|Cordialement, {N}|joindre {N} : {P}|d'après {N}, c'est prêt|le colis est au {A}|Señora {N} llamó ayer.|El señor {N} vive en {A}.|Llame al {P} y pregunte por {N}.|Su pasaporte es {I}.|DNI: {I}|NIE {I}|enviar a {A}, {K}
Correo: {E}|Atentamente, {N}|gracias a {N}|mi teléfono es {P}|escríbame a {E}|A senhora {N} ligou.|O senhor {N} mora em {A}.|Ligue para {P} e fale com {N}.|O passaporte é {I}.|CPF {I}|NIF: {I}|entregar em {A}, {K}|e-mail: {E}|Atenciosamente, {N}|obrigado, {N}
{N} {o} the {w} on {d}.|{N} {o} it|{N} {o} {s} {w}s again|{N} would like the {w} at {A}|{N} wants to {v} the {w}|{N} needs {9} {w}s|{N} has left.|{N} is the owner of the {w}|the {w} belongs to {N}|{w} {o} by {N}|{o} by {N}, see {f}|{w} goes to {N}, {A}|it was {o} for {N} ({P})|{N} can be reached on {P}
{I} is her passport number|{I} is listed as my national id|the form has {I} as the tax number|it prints {I} where the SSN should be hidden|{I} (SSN)|{I} (passport)|a social security number, {I}, is in {f}|why is {I}, my passport, in the {w}?|remove my id {I} from the {w}|the {w} contains passport {I} and phone {P}|{I} still appears as identity number
the record has {N}, {A}, {P}|{w} holds {N}, {A} and {I}|{N}, {A}, {P}, {I}|{N};{A};{P};{I}|{N};{E};{P}|{N}|{N}\t{A}\t{P}\t{E}|{A}; {P}|row {9}: {N}, {P}, {A}|test person: {N}, {A}|dummy: {N};{P};{I};{A}|{N}, born {d}, {A}|put the {w} to {A} please|bring it to {A}, then call {P}
{w} sent to {N}|{w} sent to {E}|{h} INFO {w}: {o} by {N}|WARN {w}: {E} {o}|ERROR {w}: no route to {P}|{h} INFO {w}: sms to {P}|{d} {h} DEBUG {w} user={E} id={I}|{d} {h} WARN {w}: field phone={P} {o}|{h} {w}: ship_to={A}|unter {P} bis {9} Uhr|{N} bittet um die Lieferung an {A}|gemeldet durch {N}, Tel. {P}
zuständig: {N}|von {N} geprüft|{N} hat die Rechnung bezahlt.|Das Paket liegt bei {N} in der {A}.|demandé par {N}, tél. {P}|le colis pour {N} est au {A}|{N} est absent jusqu'au {d}|envoyé par {N}|pedido por {N}, tel. {P}|lo pide {N}, móvil {P}|el paquete de {N} está en {A}|{N} no contesta|enviado por {N}|pedido de {N}, telemóvel {P}
a encomenda está em {A}, para {N}|{N} não respondeu|numéro de passeport {I} visible dans {f}|el número {I} del pasaporte se ve en {f}|o número do passaporte {I} está visível|die Passnummer {I} ist sichtbar|Cédula {I}|Identifikationsnummer {I} von {N}|On {d}, {N} wrote:|On {d} at {h} {N} wrote:|Am {d} schrieb {N}:|Le {d}, {N} a écrit :|El {d}, {N} escribió:|Em {d}, {N} escreveu:|reach me under {P} until {9}|{N} is reachable under {P}|{N}, reachable on {P}, knows more|{P} until noon|under {P} all day|{w} for {N} (id {I}) {o}|{w} of {N} (ID no. {I})|card (id number {I}) {o}|id no {I}
numéro {I} dans {f}|el número {I} está en {f}|o número {I} está em {f}|die Nummer {I} steht in {f}|nº {I}, a nombre de {N}|Ausweis {I}|{w} in der {A}, bei {N}|au {A}, chez {N}|en {A}, con {N}|em {A}, com {N}|bei {N}, {A}|La signora {N} abita in {A}.|codice fiscale {I}|chiamare {N} al {P}|Mevrouw {N} woont op {A}.|bel {N} op {P}|BSN {I}|personnummer {I}|PESEL {I}
""".replace("\n", "|")
LETTERS = "{x},{n}{N}|{x},{n}{N}{n}{A}|{x},{n}{N}{n}{P}|{x}{n}{N}{n}{A}{n}{K}|{x},{n}{n}{N}{n}{E}|{N}{n}{A}{n}{K}{n}{P}|{N}{n}{P}{n}{E}|-- {n}{N}{n}{E}|{x},{n}{N}{n}{P}{n}{E}|{N}{n}{A}|{x},{n}{N}{n}{A}{n}{P}|{N} | {P} | {E}"
CLOSINGS = "Regards|Best regards|Kind regards|Yours|Sincerely|Cheers|Thanks|Best|Thank you|BR|Gruß|Viele Grüße|Beste Grüße|Cordialement|Bien à vous|Saludos|Un saludo|Abraço|Cumprimentos|Saluti|Groeten".split("|")
KEYS = {
    "N": "name full_name fullName customer contact owner author assignee employee patient recipient user_name holder reviewer reporter responsible client person signed_by cardholder sender Kunde nombre nom nome".split(),
    "E": "email mail e-mail contact_email emailAddress to from cc bcc reply_to sender recipient login user account owner_email notify correo courriel".split(),
    "P": "phone tel mobile cell fax telephone phone_number contact_no phoneNumber home_phone msisdn caller callback telefon téléphone telefono hotline pager".split(),
    "I": "ssn customer_ssn national_id passport passport_no tax_id taxId nino dni id_number personnummer social_security tin cpf nif bsn insurance_no idNumber steuer_id identity_no nie cni nid".split(),
    "A": "address addr street home_address ship_to billing_address residence location street1 address_line1 delivery adresse direccion morada deliver_to".split(),
}
PLAIN_KEYS = "id version port host path size count timeout branch commit build revision date time hash checksum key token order order_no invoice sku part serial ticket customer_id user_id session pid tid offset line width height color url image tag region zone level status mode title label theme project board milestone server product team".split()
PLAIN = """
The {w} is {s}.|{v} the {w} before the {w}|the {s} {w} was not {s}|We should {v} {9} {w}s first.|{w} {9} of {9}|see #{9}|closes #{9}|since {9}.{9}.{9}|on {d} at {h}|{w} v{9}.{9}|{9} {w}s in {9} ms|retry {9}/{9} for {w}|no {w} in {f}|{f}:{9}: {w} is {s}
Project {G} is {s}.|The {G} project needs a {w}.|server {G} is {s}|host {g}-{9} does not answer|Board {G} {C} shows {9} {w}s|Team {C} {v}s the {w}|Theme {G} {C} hides the {w}|Release {F} {C} is {s}|the {F} board has {9} rows|Milestone {F} {9} is late|Sprint {F}|codename {F}
The {F} Foundation publishes the {w}.|{F} & {F} GmbH|{F} Inc. sells {w}s|{F} Street View renders {9} tiles|the {F} Bridge opens in {9}|Lake {F} is {s}|City of {F}|{F} Park is closed|the {F} River|Mount {F}|the {F} {w} in {f}|{F} University|{F} algorithm|{F} distance|{F} sort
Welcome To The {W} {W}|Getting Started With {W}|{W} {W}|{W} {W} {W}|# {W} {W}|## {W}|Open The {W} Menu|{C} {W}|Main {W}|New {W}|Monday Morning|New York|San {F}|North {F}|Data {W}|Error {9}: {W} {s}|{W}{W}|class {W}{W}|{W}{W}.{v}{W}()|new {W}{W}({9}, {9})
git clone git@{D}:{g}/{w}.git|https://{D}/{w}/{9}?{w}={9}|ssh://git@{D}/{w}.git|npm install @{w}/{w}@{9}.{9}.{9}|pip install {w}=={9}.{9}|@{w} decorators {v} the {w}|thanks @{g}{9}|user @{g}_{w}|{g}_{w} pushed to {w}|@media (min-width: {9}px)|@Override|import {w}.{w}
{h} INFO {w}: {v} {w} {9}|{d}T{h}Z WARN {w}-{9} {w} is {s}|ERROR [{w}] cannot {v} {f}|DEBUG {w}={9} {w}={9}|[{h}] {g}: the {w} is {s}|{x9}|commit {x9}|sha256:{x9}{x9}|uuid {u}|id={u}|{i}|{i}:{9}|ip {i} is {s}|port {9}|range {9}-{9}|{9}-{9}-{9}|{9}x{9}
part number {9}-{9}-{9}|serial no. {z}|order {z} is {s}|invoice no. {z}|ISBN 978-{9}-{9}-{9}|tracking {z}|account balance {9}.{9}|{9},{9} EUR|{9}.{9} ms|${9}.{9}|timestamp {z}|ticket {z}|build {z}|case {9}/{9}|version {9}.{9}.{9}-{9}|article {z}|batch {z}|epoch {z}|{9} {9} {9} {9}
Copyright {9} the {w} authors|Copyright (c) {9} {F} Ltd.|All rights reserved.|Licensed under the {F} License|generated from {f} on {d}|do not edit|Generated by {w}|by the {w} team|Author: the {w} team|TODO: {v} the {w}|FIXME {w} {9}|TODO(#{9}): {v} {w}|// {v} {w}|/* {w} {s} */
const {w} = {9};|let {w}{W} = {w}.{v}({w});|if ({w} == {9}) return {w};|def {v}_{w}(self, {w}):|for {w} in {w}s:|return {w}.{v}({9})|{w}: {{ {w}: {9}, {w}: "{s}" }}|<{w} id="{w}-{9}">{s}</{w}>|"{w}": "{s}",|{w},{w},{w}|{9},{9},{9}|{w} = [{9}, {9}, {9}]|#define {U}_{U} {9}
{9} {w}s {o}|INFO {w}: {9} {w}s {o}|{d} {h} INFO {w}: {9} {w}s {o}|{h} WARN {w}: {s} {w} {x9}|{d} {h} WARN {w}: {s} {w}|{d} {h} ERROR {w}: cannot {v} {f}|{d} {h} INFO {w}: {v} {w} {9} -> {9} {w}s|{v} {x9}|{W} {x9}|Undo {x9}|{9} {w}s are {s}|{9} of {9} {w}s {o}|{w}: {9} {w}s, {9} {w}s|{s} {w} {s} {w}|{s} {w}, {s} {w}
{W} {w} {m} is {s}|{w} {m} ({w} number)|{W} {m} {o}|{w} numbers {m} to {m}|{w} {m} {o}, see #{9}|{w} {m} / {m} is only a {w}|the {w} {m} is {o}|{w} no. {m}|part {m}|model {m}|spare {w} {m}|Build {m} {o}|branch {m}|{m} is a {w}|La {w} {m} no existe|Le {w} {m} est absent|Der {w} {m} fehlt|O {w} {m} falta|range {m}|{w}={m}|label {m}
{w} {d} / {d}|{d} / {d}|from {d} to {d}|a {w} number|the phone number is {s}|the {w} number of the {w}|tax number format|email address of the {w}|passport check {o}|{w} and {w} of the {w}|{w} or {w}, {s} or {s}|{s} {w} without {w}|on call this week|the {w} on call
{y} {9}|{y} #{9}|{y} #{9} {s}|{W} #{9} is {s}|the {w} #{9}|{y} {m}|{y} {m}, {y} {9}|{y} {g}{w} {9}.{9}.{9}|with {g}{w} {9}.{9}.{9}-rc{9}|{g}{w}@{9}.{9}|package {g}{w}|package {w}|from {g}{w} import {w}|module {g}{w}|use {g}{w}|{U}-{U} {U}|{U} {U} {U}|{U} {U}|// {U} {U}|{y}, der {y}|{9} {y}, der {y}|{9} {y}, die {y}|{y}, das {y}
{9} Main {W} items|{9} {W} {W} entries|Level {9} {W}|Room {9}|Chapter {9}: {W} {W}|Section {9}.{9}|Lane {9} is {s}|Court {9} has {9} rows|row {9} of the {w}|{9} High {W}s|Unit {9} tests|Phase {9} of {F}|Way {9}|{9} {s} {w}s|Figure {9}|Floor {9} is {s}|route {9}|Drive {9} is {s}
"""
PERSONAL_T = [x for x in FRAMES.split("|") if x]
LETTERS_T = [x.replace("\x00", "|") for x in LETTERS.replace(" | ", "\x00").split("|")]
PLAIN_T = [x for x in PLAIN.replace("\n", "|").split("|") if x]
KIND = {"N": "person_name", "E": "email", "P": "phone", "I": "id_number", "A": "street_address"}
_PART = re.compile(r"(\{\w9?\})")


def _ascii(s: str) -> str:
    for a, b in (("ø", "o"), ("Ø", "O"), ("æ", "a"), ("ß", "ss"), ("ł", "l"), ("ı", "i")):
        s = s.replace(a, b)
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


class Maker:
    def __init__(self, seed: int, background: list[str] | None = None, hard: list[str] | None = None):
        self.r = random.Random(seed)
        self.background = background or []
        self.hard = hard or []
        self.fills = {
            "N": self.name, "E": self.email, "P": self.phone, "I": self.ident, "A": self.address, "K": self.city, "w": lambda: self.r.choice(THINGS), "v": lambda: self.r.choice(DOES), "s": lambda: self.r.choice(HOW),
            "o": lambda: self.r.choice(DONE), "m": self.marks, "y": self.local, "9": self.number, "z": lambda: self.r.choice(("", "A-", "INV", "PO-", "20")) + self.digits(self.r.randint(4, 12)), "f": self.path, "d": self.date, "h": lambda: f"{self.r.randint(0, 23):02}:{self.r.randint(0, 59):02}" + (f":{self.r.randint(0, 59):02}" if self.r.random() < 0.5 else ""),
            "t": lambda: self.r.choice("Mr Mrs Ms Dr Prof Mr. Mrs. Ms. Dr. Prof.".split()), "G": self.given, "g": lambda: _ascii(self.given()).lower(), "F": self.family, "C": lambda: self.r.choice("Blue Green Dark Light Red Core One Next Alpha Lite Pro Night Gold".split()), "W": lambda: self.r.choice(THINGS).title(),
            "U": lambda: self.r.choice(THINGS).upper(), "D": self.domain, "i": lambda: ".".join(str(self.r.randint(0, 255)) for _ in range(4)), "x9": lambda: self.hexes(self.r.choice((7, 8, 12, 40))), "u": lambda: "-".join(self.hexes(n) for n in (8, 4, 4, 4, 12)), "x": lambda: self.r.choice(CLOSINGS), "n": lambda: self.nl,
        }
        self.nl = "\n"

    def hexes(self, n: int) -> str:
        return "".join(self.r.choices("0123456789abcdef", k=n))

    def digits(self, n: int) -> str:
        return "".join(self.r.choices("0123456789", k=n))

    def number(self) -> str:
        return str(self.r.randint(0, 10 ** self.r.choice((1, 2, 2, 3, 4))))

    def local(self) -> str:
        lang = self.r.choice(tuple(LOCAL))
        x = self.r.choice(LOCAL[lang][0])
        return self.r.choice({"de": ("Der ", "Die ", "Das ", "", "", "Ein ", "Mit ", "Im "), "fr": ("Le ", "La ", "Un ", "Avec ", ""), "es": ("El ", "La ", "Un ", "Con ", ""), "pt": ("O ", "A ", "Um ", "Com ", "")}[lang]) + x

    def marks(self) -> str:
        """Groups of digits that are no one's number."""
        r = self.r
        if r.random() < 0.2:
            return f"{r.choice(('A', 'FT', 'v', 'rel', 'R2'))}-{self.digits(r.randint(2, 5))}-{self.digits(r.randint(1, 5))}"
        return r.choice(("-", "-", "-", "/", ".", " - ")).join((("0" if r.random() < 0.12 else "") + self.digits(r.randint(1, 6))) for _ in range(r.choice((2, 3, 3, 3, 4))))

    def date(self) -> str:
        y, m, d = self.r.randint(1950, 2030), self.r.randint(1, 12), self.r.randint(1, 28)
        return self.r.choice((f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{d}/{m:02}/{y % 100:02}", f"May {d}, {y}", f"{d} March {y}", "Monday", "Friday"))

    def path(self) -> str:
        r = self.r
        return "/".join(r.choice(THINGS) for _ in range(r.randint(1, 3))) + r.choice(("/", "_")) + r.choice(DOES) + "." + r.choice("py go c ts java rs md json yaml txt".split())

    def syllables(self, n: int) -> str:
        r = self.r
        return "".join(r.choice(("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z", "h", "j", "w", "ch", "sh", "br", "dr", "gr", "kr", "st", "tr", "th", "kl", "fl", "")) + r.choice(("a", "e", "i", "o", "u", "a", "e", "i", "o", "ai", "ou", "ei", "ie", "ö", "é", "y")) + r.choice(("", "", "", "n", "r", "l", "s", "m", "nd", "rt", "ck", "ll", "x")) for _ in range(n))

    def given(self) -> str:
        r = self.r
        x = r.random()
        if x < 0.40:
            return r.choice(GIVEN)
        return (self.syllables(r.choice((1, 1, 2))) + r.choice(FIRST_ENDINGS)).title() if x < 0.75 else (self.syllables(r.choice((1, 2, 2, 3))) + r.choice(("", "a", "o", "e", "us", "in", "ia", "ik"))).title()

    def family(self) -> str:
        r = self.r
        x = r.random()
        if x < 0.30:
            return r.choice(FAMILY)
        if x < 0.80:
            return (self.syllables(r.choice((1, 1, 2))) + r.choice(ENDINGS)).title()
        if x < 0.86:
            return r.choice(("O'", "Mc", "Mac", "D'", "Al-", "El-")) + self.syllables(2).title()
        if x < 0.92:
            return r.choice(TREES) + r.choice(ENDINGS)
        return self.syllables(r.choice((2, 3))).title()

    def name(self) -> str:
        r = self.r
        given, family = self.given(), self.family()
        if r.random() < 0.08:
            given += r.choice((" ", "-")) + self.given()
        if r.random() < 0.10:
            family += "-" + self.family()
        if r.random() < 0.12:
            family = r.choice("von|van|de|de la|al|van der|van den|da|del|dos|di|bin|ter|zu|della|le|von der|do".split("|")) + " " + family
        x = r.random()
        if x < 0.14:
            s = f"{family}, {given}"
        elif x < 0.24:
            s = f"{given[0]}. {family}"
        elif x < 0.26:
            s = f"{given[0]}. {r.choice('ABCDEFGHJKLMNPRSTW')}. {family}"
        elif x < 0.35:
            s = f"{given} {r.choice('ABCDEFGHIJKLMNOPRSTUVW')}. {family}"
        elif x < 0.39:
            s = f"{family} {given}"
        else:
            s = f"{given} {family}"
        x = r.random()
        return s.lower() if x < 0.07 else s.upper() if x < 0.13 else s

    def domain(self) -> str:
        r = self.r
        host = r.choice((r.choice(THINGS), self.syllables(2), _ascii(self.family()).lower(), f"{r.choice(THINGS)}-{r.choice(HOW)}", r.choice("gmail yahoo outlook gmx posteo proton".split())))
        return (r.choice(("", "", "", "mail.", "lists.", "m.", "cs.")) + host + "." + r.choice(TLD)).replace(" ", "")

    def email(self) -> str:
        r = self.r
        g, f = re.sub(r"[^a-z]", "", _ascii(self.given()).lower()) or "kim", re.sub(r"[^a-z]", "", _ascii(self.family()).lower()) or "li"
        local = r.choice((f"{g}.{f}", f"{g}.{f}", f"{g[0]}{f}", f"{g}_{f}", f"{g}-{f[:4]}", f"{f}", f"{g}", f"{f}.{g[0]}", f"{g}{self.digits(2)}", f"{r.choice(THINGS)}", f"{g}.{f}{self.digits(r.choice((1, 2)))}"))
        if r.random() < 0.12:
            local += "+" + r.choice((*THINGS, "dev", "ci", "spam"))
        domain = self.domain()
        x = r.random()
        if x < 0.05:
            return f"{local}@{domain}".upper()
        if x < 0.10:
            return f"{local.title()}@{domain.title()}"
        if x < 0.40:
            at = r.choice(("(at)", " (at) ", "[at]", " [at] ", " at ", " AT ", " at ", "{at}", "<at>", " @ ", " @ ", "(AT)"))
            dot = r.choice((" dot ", " [dot] ", "(dot)", ".", " (dot) ", "[dot]")) if at.strip() != "@" else "."
            if at.strip().lower() == "at":
                dot = r.choice((" dot ", " dot ", " DOT ", " [dot] ", " (dot) "))
            return f"{local}{at}{domain.replace('.', dot)}"
        return f"{local}@{domain}"

    def phone(self) -> str:
        r, d = self.r, self.digits
        sep = r.choice((" ", " ", "-", ".", "", "/", "\u2011", "\u00a0", "\u2013"))
        if r.random() < 0.45:
            a, b, c = r.choice("23456789") + d(2), r.choice(("555", d(3), d(3))), d(4)
            s = r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+1 {a} {b} {c}", f"+1{a}{b}{c}", f"1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"({a}){b}-{c}", f"{a}/{b}-{c}"))
        else:
            groups = [d(n) for n in r.choice(((2, 4, 4), (3, 3, 3), (1, 2, 2, 2, 2), (2, 2, 2, 2, 2), (4, 6), (4, 3, 3), (3, 7), (2, 8), (3, 4, 4), (3, 3, 4), (2, 3, 2, 2), (5, 4), (2, 5, 3), (4, 3, 4), (1, 8), (3, 5, 3), (2, 4, 3), (3, 8)))]
            if r.random() < 0.6:
                s = r.choice(("+", "+", "+", "00")) + str(r.choice((44, 49, 33, 34, 39, 31, 351, 48, 46, 47, 45, 358, 41, 43, 55, 52, 91, 86, 81, 82, 61, 64, 27, 234, 90, 7, 380, 353, 32))) + r.choice((" ", " ", "-", "", " (0)")) + sep.join(groups)
            else:
                s = "0" + (sep.join(groups) if r.random() < 0.8 else f"{groups[0]}{r.choice((' ', '/', '-', ' / '))}{''.join(groups[1:])}")
                if r.random() < 0.15:
                    s = f"({s.split(sep)[0] if sep else s[:4]}) {sep.join(groups[1:])}"
        if r.random() < 0.14:
            s += r.choice((" ext. ", " ext ", " x", ", ext. ", " extension ", "x")) + d(r.choice((2, 3, 4)))
        return s

    def ident(self) -> str:
        r, d = self.r, self.digits
        letter = lambda n=1: "".join(r.choices("ABCDEFGHJKLMNPQRSTVWXYZ", k=n))
        dmy = f"{r.randint(1, 28):02}{r.randint(1, 12):02}{r.randint(0, 99):02}"
        return r.choice((
            f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9), d(9), f"{letter(2)}{d(6)}{r.choice('ABCD')}", f"{letter(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{letter(2)}{d(2)} {d(2)} {d(2)}{r.choice('ABCD')}",
            f"{letter()}{d(7)}", f"{letter()}{d(8)}", f"{letter(2)}{d(7)}", f"{letter()}{d(6)}{letter()}", f"{d(8)}{letter()}", f"{d(8)}-{letter()}", f"{d(2)}.{d(3)}.{d(3)}-{letter()}", f"{r.choice('XYZ')}{d(7)}{letter()}", f"{r.choice('XYZ')}-{d(7)}-{letter()}",
            f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", d(11), f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{letter(6)}{d(2)}{letter()}{d(2)}{letter()}{d(3)}{letter()}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)} {d(4)} {d(4)}",
            f"{letter(5)}{d(4)}{letter()}", f"{dmy}-{d(4)}", f"{dmy} {d(5)}", f"{dmy}{r.choice('-+A')}{d(3)}{letter()}", f"{d(2)}-{d(7)}", f"{letter()}{d(2)}{letter()}{d(5)}", f"{d(10)}", f"{d(3)}-{d(3)}-{d(3)}", f"{d(2)}/{d(3)}/{d(5)}", d(8),
        ))

    def city(self) -> str:
        r = self.r
        name = r.choice((self.family(), "Springfield", "London", "Berlin", "Lyon", "Porto", "Madrid", "Dublin", "Chicago"))
        return r.choice((f"{self.digits(5)} {name}", f"{name} {self.digits(5)}", f"{name}, {r.choice('CA NY TX WA IL'.split())} {self.digits(5)}", f"{name} {r.choice('SW N E W'.split())}{r.randint(1, 20)} {r.randint(1, 9)}{r.choice('ABDEF')}{r.choice('ABDEF')}", name, f"{self.digits(4)}-{self.digits(3)} {name}"))

    def street(self) -> str:
        r = self.r
        x = r.random()
        if x < 0.3:
            return r.choice(TREES)
        if x < 0.4:
            return f"{r.choice(TREES)} {r.choice(TREES)}"
        if x < 0.6:
            return self.family()
        if x < 0.8:
            return (self.syllables(r.choice((1, 2))) + r.choice("field wood hill bury side brook mead stone well ford view dale lea croft bourne combe".split())).title()
        return r.choice(TREES) + r.choice("field wood hill side stone view dale brook".split())

    def address(self) -> str:
        r = self.r
        n = str(r.randint(1, 10 ** r.choice((1, 2, 2, 3, 3, 4)))) + (r.choice("abcABCD") if r.random() < 0.12 else "")
        if r.random() < 0.04:
            n = f"{r.randint(1, 90)}-{r.randint(91, 99)}"
        p, x = self.street(), r.random()
        if x < 0.52:
            s = f"{n} {r.choice(('', '', '', '', 'N ', 'S. ', 'East ', 'Old ', 'Upper '))}{p} {r.choice(WAYS)}"
            if r.random() < 0.06:
                s = f"{n} {r.choice(('Broadway', 'The Mall', f'{r.randint(2, 99)}th {r.choice(WAYS)}', f'The {p}'))}"
            unit = r.choice(("Apt", "Apt.", "Apartment", "Unit", "Suite", "Ste", "#", "Flat", "Floor", "Room")) + r.choice((" ", " ", "")) + str(r.randint(1, 400)) + r.choice(("", "", "A", "b", "C"))
            if r.random() < 0.26:
                s += r.choice((", ", " ", ", ")) + unit
            elif r.random() < 0.14:
                s = f"{r.choice(('Flat', 'Unit', 'Apt', 'Apartment', 'Suite'))} {r.randint(1, 99)}{r.choice(('', 'A', 'B'))}, {s}"
            elif r.random() < 0.05:
                s += f", {r.choice(('2nd', '3rd', '1st', '4th', 'ground'))} floor"
        elif x < 0.68:
            q = r.choice((p.split()[0], p.split()[0], self.syllables(2).title()))
            s = r.choice((f"{q}straße {n}", f"{q}strasse {n}", f"{q}str. {n}", f"{q}weg {n}", f"{q}gasse {n}", f"{q}platz {n}", f"{q}allee {n}", f"{q}ring {n}", f"Am {q} {n}", f"An der {q} {n}", f"{q}-{p.split()[-1]}-Straße {n}", f"{q}er Straße {n}", f"Im {q} {n}", f"{q}straat {n}", f"{q}laan {n}", f"{q}gatan {n}", f"{q}veien {n}"))
            if r.random() < 0.1:
                s += r.choice((", 2. OG", ", Hinterhaus", " links", ", Whg. 4", ", 3. Stock"))
        elif x < 0.80:
            s = f"{n}{r.choice(('', '', ' bis', ' ter'))}{r.choice((', ', ' ', ' '))}{r.choice(('avenue', 'rue', 'rue', 'impasse', 'boulevard', 'place', 'chemin', 'allée', 'quai', 'cours', 'route'))} {r.choice(('', '', 'du ', 'de la ', 'des ', 'de '))}{p}"
            if r.random() < 0.12:
                s += r.choice((", 2e étage", ", bât. B", ", appt 12", ", 3ème étage"))
        elif x < 0.91:
            s = f"{r.choice(('C/ ', 'Calle ', 'Calle de ', 'Avenida ', 'Avda. ', 'Av. ', 'Plaza ', 'Paseo de ', 'Carrera ', 'Camino '))}{p}{r.choice((' ', ', ', ', nº ', ' #'))}{n}" + (r.choice((f", {r.randint(1, 9)}º {r.choice('ABCD')}", f", piso {r.randint(1, 9)}", f", {r.randint(1, 9)}º izq.", f", {r.randint(1, 9)}°")) if r.random() < 0.35 else "")
        else:
            s = f"{r.choice(('Travessa da ', 'Rua ', 'Rua do ', 'Rua da ', 'Rua dos ', 'Largo do ', 'Praça da ', 'Via ', 'Viale ', 'Piazza ', 'Corso ', 'Alameda ', 'Estrada da '))}{p}{r.choice((' ', ', ', ', nº '))}{n}" + (r.choice((f", {r.randint(1, 9)}º", f", apto {r.randint(1, 99)}", f", {r.randint(1, 9)}º Dto", f", int. {r.randint(1, 9)}")) if r.random() < 0.25 else "")
        x = r.random()
        return s.lower() if x < 0.08 else s.upper() if x < 0.12 else s

    def fill(self, template: str) -> tuple[str, list[tuple[int, int, str]]]:
        text, found = "", []
        for part in _PART.split(template.replace("{{", "\0").replace("}}", "\1")):
            key = part[1:-1] if _PART.fullmatch(part) else ""
            x = self.fills[key]() if key else part.replace("\0", "{").replace("\1", "}")
            if key in KIND:
                found.append((len(text), len(text) + len(x), KIND[key]))
            text += x
        return text, found

    def record(self, personal: bool) -> tuple[str, list[tuple[int, int, str]]]:
        """Key and value pairs, lines of a table, attributes, log fields: with or without personal values."""
        r = self.r
        shape = "{v}" if r.random() < 0.25 else r.choice(("{k}: {v}", '{k}: "{v}"', '"{k}": "{v}"', '"{k}":"{v}"', '"{k}":"{v}"', "{k}={v}", '{k}="{v}"', '{k} = "{v}"', "'{k}': '{v}'", "<{k}>{v}</{k}>", "{k} -> {v}", "{k} ({v})", "{k} {v}", "{k}: '{v}'", "{k};{v}"))
        glue = r.choice((", ", " ", "; ", ";", ",", " | ", "\t", self.nl, " && "))
        text, found = r.choice(("", "", "{ ", "(", "row: ", "INFO ", "WARN ", "DEBUG ", "insert ", "fixture ", "const ", "expected ")), []
        for k in range(r.randint(1, 5)):
            kind = r.choice("NNEEPPIIAA") if personal and r.random() < 0.75 else ""
            key = r.choice(KEYS[kind] if kind else PLAIN_KEYS)
            key = r.choice((key, key, key.upper(), key.title(), f"customer_{key}", key.replace("_", " ")))
            value = self.fills[kind]() if kind else self.fill(r.choice(("{9}", "{x9}", "{d}", "{f}", "{w}", "{s}", "{9}.{9}.{9}", "{u}", "{i}", "{z}", "{W} {W}", "{G}", "{F}-{9}", "{9}-{9}", "{D}", "{F}", "{G} {C}", "{w} {w}")))[0]
            if kind == "I" and shape == "{v}" and not found:
                continue  # a bare number alone says nothing
            a, b = shape.replace("{k}", key).split("{v}")
            text += (glue if k else "") + a
            if kind:
                found.append((len(text), len(text) + len(value), KIND[kind]))
            text += value + b
        return text, found

    def foreign(self) -> str:
        r = self.r
        things, how, small = LOCAL[r.choice(("de", "fr", "es", "pt"))]
        words = [r.choice((r.choice(small), r.choice(things), r.choice(small), r.choice(how))) for _ in range(r.randint(3, 9))]
        if r.random() < 0.25:
            words.insert(r.randint(1, len(words)), r.choice((self.given(), self.number(), self.path(), "Server " + self.given(), f"{self.given()} {r.choice('Blue Dark Next Pro'.split())}")))
        for k in range(1, len(words) - 1):
            if r.random() < 0.12:
                words[k] += ","
            elif r.random() < 0.06:
                words[k] = f"{self.number()} {r.choice(things)}"
        s = " ".join(words)
        return s[0].upper() + s[1:] + r.choice((".", ".", "", "!", "?", ":"))

    def inserted(self, personal: bool) -> tuple[str, list[tuple[int, int, str]]]:
        """A line of the background, or words, with a value or a capitalised phrase of its own words put in anywhere."""
        r = self.r
        words = r.choice(self.background).split() if self.background else self.fill(r.choice(PLAIN_T))[0].split()
        at = r.randint(0, len(words)) if r.random() < 0.75 else r.choice((0, len(words)))
        text, found, once = "", [], r.choice("NNNNNNNNAAAE") if personal else ""
        for k in range(len(words) + 1):
            if k == at:
                if personal:
                    x = self.fills[once]()
                    found.append((len(text), len(text) + len(x), KIND[once]))
                else:
                    pool = [w.strip(".,:;()").lower() for w in self.r.choice(self.background or [" ".join(THINGS)]).split()]
                    pool = [w for w in pool if w.isalpha() and len(w) > 2] or THINGS
                    x = " ".join(r.choice(pool).title() for _ in range(r.choice((2, 2, 2, 3))))
                    if r.random() < 0.2:
                        x = f"{self.number()} {x}"
                text += x + (r.choice((" ", " ", " ", ", ", ": ", "'s ")) if k < len(words) else r.choice(("", "", ".", "!", "?")))
            if k < len(words):
                text += words[k] + (" " if k < len(words) - 1 or at == len(words) else "")
        return text, found

    def plain(self) -> str:
        x = self.r.random()
        if x < 0.06:
            return self.inserted(False)[0]
        if self.hard and x < 0.25:
            return self.r.choice(self.hard)
        if self.background and x < 0.62:
            return self.r.choice(self.background)
        if x < 0.70:
            return self.record(False)[0]
        return self.foreign() if x < 0.78 else self.fill(self.r.choice(PLAIN_T))[0]

    def example(self, length: int) -> tuple[str, list[tuple[int, int, str]]]:
        """A stretch of text of about the length, and its spans."""
        r = self.r
        style = r.random()
        lead = r.choice(("// ", "# ", "/* ", " * ", "; ", "-- ", "<!-- ", "    ", "> ", "- ", "\t// ")) if style < 0.3 else "chat" if style < 0.4 else ""
        self.nl = r.choice(("\n", "\n", "\n", "\r\n"))
        text, found = "", []
        while len(text) < length + 60:
            x = r.random()
            if x < 0.09:
                s, f = self.inserted(True)
            elif x < 0.24:
                s, f = self.fill(r.choice(PERSONAL_T))
            elif x < 0.30:
                s, f = self.fill(r.choice(LETTERS_T))
            elif x < 0.40:
                s, f = self.record(True)
            else:
                s, f = self.plain(), []
            p = f"[{self.fills['h']()}] {self.fills['g']()}{r.choice(('', '_', '.'))}{r.choice(THINGS)[:4]}: " if lead == "chat" else lead
            text += p
            found += [(a + len(text), b + len(text), k) for a, b, k in f]
            text += s + (self.nl if lead else r.choice((" ", " ", self.nl, self.nl + self.nl, self.nl, ". ")))
        return text, found

    def window(self, length: int) -> tuple[str, list[tuple[int, int, str]]]:
        """A window of exactly the length (shorter at times), cut anywhere, and its spans, cut too."""
        text, found = self.example(length)
        x = self.r.random()
        start = 0 if x < 0.3 else self.r.randint(0, max(0, len(text) - length))
        end = start + (length if self.r.random() < 0.8 else self.r.randint(min(20, length), length))
        return text[start:end], [(max(a, start) - start, min(b, end) - start, k) for a, b, k in found if a < end and b > start]


_NO_BACKGROUND = re.compile(
    r"(?i:\bat\b.*\bdot\b|author|contribut|thanks|copyright|maintain|credit|written|invented|due to|phone|e-?mail|ssn|passport|\bby [A-Z]\w)|\d[\d .()-]{6,}\d|(?:^|[^\w.])[A-Z][\w.'-]*,? (?:[a-z]{1,3} )?[A-Z][\w'-]"
    r"|\d+ [A-Z]\w+ [A-Z]|\b(?:rue|straße|street|avenue|road) |[A-Z]\w+ \d+$"
)
_BACKGROUND_AT = re.compile(r"^\s*@\w|git@|@param|@return|\[\w@|@\w+/|\w@\d")
_SUFFIXES = (".py", ".md", ".rst", ".txt", ".c", ".h", ".js", ".java", ".json", ".toml", ".cfg", ".html", ".css", ".xml", ".sh", ".pyx", ".yaml", ".yml", ".ts")


def read_texts(folders: list[str], seed: int, most: int) -> Iterator[str]:
    """At most so many texts of the folders, in random order: no file above 200 kB."""
    paths = [p for f in folders for p in Path(f).rglob("*") if p.suffix in _SUFFIXES and p.is_file() and p.stat().st_size < 200_000]
    random.Random(seed).shuffle(paths)
    for p in paths[:most]:
        yield p.read_text("utf-8", "replace")


def background(texts: Iterator[str], most: int, seed: int) -> list[str]:
    """At most so many lines of the texts in which nothing looks personal."""
    rng, kept, seen = random.Random(seed), [], 0
    for text in texts:
        for s in text.splitlines():
            s = s.strip()[:200]
            if len(s) < 4 or _NO_BACKGROUND.search(s) or ("@" in s and not _BACKGROUND_AT.search(s)):
                continue
            seen += 1
            if len(kept) < most:
                kept.append(s)
            elif (k := rng.randrange(seen)) < most:
                kept[k] = s
    return kept
