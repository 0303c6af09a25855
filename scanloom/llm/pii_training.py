"""Labelled texts for the personal-data model, made from general knowledge.

No labelled documents exist, so the model is trained on generated ones: everyday sentences, records, logs and code in
three languages with slots for the five kinds of personal data, and texts that only look like it.  Sentences, names,
streets and words were written down for this module from what is commonly known (frequent given and family names of
many countries, kinds of streets, colours, materials, things, public number formats); none was taken from a table that
the operator is run on.  Half of all names are made from syllables, so that the model learns a name's shape and
surroundings rather than a list.  Every fifth sentence and name is kept for the held-out part.  ``SENTENCES`` bounds
the sample.
"""

from __future__ import annotations

import random

#: Size of the training sample (a parameter of ``pii.model``), and of the part that fits the skip edges' weight.
SENTENCES, HELD_SENTENCES = 20_000, 2_500

# Frequent given names, family names, and syllables that names are made of.
GIVEN = """Amelia Noah Olivia Liam Charlotte Ethan Sophie Jack Harriet Benjamin Rebecca Daniel Megan Samuel Victoria Joseph Nicole Andrew Lauren Matthew Heather Patrick Julia Kevin Fiona Brian
Helen George Margaret Philip Catherine Martin Joanna Stephen Alison Jonathan Natalie Christopher Deborah Kenneth Monica Gregory Sandra Douglas Angela Priya Arjun Anjali Rahul Deepa Vikram Mei Wei
Jun Hiroshi Yuki Kenji Sakura Min-jun Soo Fatima Omar Layla Yusuf Amina Khalid Zainab Kwame Ama Chidi Ngozi Tunde Thabo Lerato Ingrid Lars Astrid Erik Katarzyna Piotr Agnieszka Tomasz Olga Dmitri
Svetlana Ivan Giulia Marco Francesca Luca Chloé Julien Amélie Étienne Hans Greta Jürgen Ursula Stefan Gonçalo Inês Vasco Mariana Rodrigo Larissa Thiago Camila Leonardo Juliana Eduardo Patrícia
Fernando Débora Vinícius Letícia Gustavo Aline Márcio Simone Fábio Renata Lourdes Joaquim Conceição Álvaro Alejandro Valentina Sebastián Ximena Andrés Gabriela Ricardo Lorena Manuel Pilar Ignacio
Paloma Rubén Nuria Óscar Silvia Guillermo Esperanza Emilio Rosario Joaquín Inmaculada Xavier Montserrat Ramón Mercedes Ana Kim Luz Eva Leo Ida Bo Ava Mia Jo Tom Amy""".split()
FAMILY = """Smith Johnson Williams Jones Taylor Davies Evans Thomas Roberts Walker Wright Robinson Thompson Hughes Edwards Green Hall Wood Harris Clarke Patel Jackson Turner Hill Cooper Ward Morris Moore Bennett
Carter Phillips Mitchell Kelly Murphy O'Brien O'Connor Ryan Byrne MacDonald Campbell Stewart Fraser Nguyen Tran Chen Wang Li Zhang Liu Kim Park Lee Choi Tanaka Suzuki Watanabe Sato Sharma Gupta Singh Kumar
Raghunathan Iyer Khan Hussein Al-Sayed Haddad Nkrumah Mensah Okafor Adeyemi Dlamini Mbeki Larsen Hansen Johansson Lindqvist Nowak Kowalski Wiśniewska Petrov Ivanova Novák Horvat Rossi Bianchi Ferrari Esposito
Dubois Lefèvre Moreau Girard Müller Schmidt Schneider Weber Fischer van-Dijk Silva Santos Oliveira Souza Pereira Lima Carvalho Ribeiro Almeida Rocha Nogueira Cardoso Teixeira Moreira Barbosa Figueiredo Magalhães
Guimarães Brandão Araújo Conceição Monteiro Azevedo García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Jiménez Ruiz Hernández Díaz Álvarez Muñoz Romero Navarro Torres Domínguez Vázquez
Ramos Gil Ramírez Serrano Blanco Molina Morales Ortega Delgado Castro Ortiz Rubio Marín Iglesias Núñez Peña Ibáñez Echeverría Goikoetxea Wu Ng""".split()
SOUNDS = "ba be bi bo bra bre ca ce cla co cor cra da de del di do dra du e el fa fe fi flo fre ga gal ge gi gra gri ha hal he hol i il jo ju ka ke kel ki la le len li lo lu ma mar me mi mo na nel ni no o ol or pa pe per pi pra qui ra re ri ro ru sa se sel si so sta ste sto ta te ti tor tra tri u va ve vi vo wa we wi wo wyn ya ze zo".split()
GIVEN_ENDS = "a na ra la ia ina ela ette lyn wen is us an on en in or el o io ino aldo ard bert win ric ton".split()
FAMILY_ENDS = "son sen man er ers ley ton ham field worth well wood stead ford more den ski ska ic ov ova ez es az eira eiro edo ado inho al ar ing ach ault eau elli etti ini aga arte undo anza iz ura ães ões óz én és mont ock ell ow and".split()
PARTICLES = ["de", "da", "do", "dos", "das", "de la", "del", "van", "von", "di"]

# Common words that product names, services and packages are made of.
ADJECTIVES = """red orange yellow green blue purple pink brown black white grey silver golden bronze copper iron steel glass wooden stone marble crystal velvet silk cotton paper amber ivory jade ruby pearl coral scarlet
crimson azure indigo violet olive maple oak cedar pine birch willow early late old young new ancient modern quick slow fast rapid swift steady calm quiet silent loud bright dark dim pale clear cloudy foggy
frosty frozen icy snowy rainy stormy windy sunny solar lunar polar arctic tropical northern southern eastern western upper lower inner outer hidden open closed broken bold brave gentle kind keen sharp smooth rough
soft hard hollow deep shallow tall short wide narrow round square flat curved woven mellow misty dusty rusty nimble lucky happy lazy busy royal noble wild tame tiny giant humble electric atomic digital virtual
global local central remote""".split()
NOUNS = """river lake ocean island harbor bay beach coast cliff cave canyon valley mountain hill ridge summit forest meadow garden orchard field desert prairie bridge tower castle temple palace gate wall arch dome lighthouse
beacon lantern candle torch mirror window door stair chimney kiln furnace forge anvil hammer chisel lever pulley gear wheel axle engine turbine piston valve pump pipe wire cable battery magnet compass anchor sail
rudder mast paddle ferry barge canoe wagon carriage rocket comet meteor planet orbit galaxy star moon sun cloud thunder lightning rainbow breeze falcon eagle hawk owl raven heron swan sparrow otter beaver fox wolf
bear tiger lion panther dolphin whale salmon turtle beetle spider bee ant maple thistle clover fern moss ivy lotus orchid tulip daisy pebble boulder quarry crystal prism spindle loom lattice trellis basket barrel
bucket ladder hinge latch badge ribbon feather shield sword arrow spear helmet crown drum flute violin piano trumpet bell clock""".split()
THINGS = """account address agent alert archive backup balance basket batch bill booking branch bucket budget cache cart case catalog channel claim client cluster config contract coupon cursor customer dashboard dataset
deployment device digest document domain draft endpoint event export feature feed file filter folder form gateway header image import index invoice item job key label ledger license link list log mail manifest
message metric mirror module node note notice offer order page parcel partition password patch payment permit pipeline plan policy pool portal price profile project queue quota record refund region release replica
report request response role roster route rule sample schedule schema script secret segment server service session shard signal site snapshot socket stream task team template tenant ticket token topic trace vault
version volume voucher wallet webhook widget worker""".split()
# Frequent words of the three languages, for sentences put together at random.
WORDS = {
    "en": """the a an this that these those it its we they you i he she our their your my one two three some any every each no other another such same all both few many more most much less least own very too also only just even still
    already again always never often sometimes soon now then here there where when while until since before after during between among through over under above below into onto from to of in on at by for with without within about against
    and or but so because although though if unless whether as than like per via is are was were be been being has have had do does did will would can could may might must should not cannot isn't doesn't wasn't what which who why how
    affects allows appears applies becomes breaks builds changes checks closes comes contains copies covers creates deletes depends detects drops ends explains fails finds fixes follows gets gives grows happens helps hides holds keeps knows leaves
    lets limits lists loads looks loses makes matches means mentions misses moves needs opens passes points prevents produces protects proves provides raises reaches receives removes repeats replaces requires resets returns reviews rotates
    runs saves says scans sees seems sends serves shows skips starts stays stops stores takes tells tests throws trusts tries turns updates uses waits warns works writes found fixed kept made read said seen sent shown taken told used written""",
    "pt": """o a os as um uma uns umas este esta esse essa isso aquele aquela ele ela eles elas nós você seu sua nosso nossa de do da dos das em no na nos nas por pelo pela para com sem sob sobre entre até desde após antes durante contra e ou mas
    porque pois embora se quando enquanto onde como que quem qual quais não sim já ainda sempre nunca também só apenas mesmo muito pouco mais menos todo toda todos cada outro outra algum nenhum dois três é são foi era ser está estão tem têm há
    deve pode faz vai vem lê abre grava fecha envia recebe usa mostra perde falha retorna gera guarda aceita nega precisa permite contém depende corrige chama espera roda passa arquivo chave código erro falha rotina pacote serviço regra linha
    varredura versão alerta equipe painel senha rede dado texto tabela valor pedido cliente conta página pasta teste carga cópia lista fila mês dia hora semana""",
    "es": """el la los las un una unos unas este esta ese esa eso aquel aquella él ella ellos nosotros usted su sus nuestro nuestra de del en por para con sin bajo sobre entre hasta desde tras antes después durante contra y o u pero porque pues aunque si
    cuando mientras donde como que quien cual cuales no sí ya aún todavía siempre nunca también solo apenas mismo muy poco más menos todo toda todos cada otro otra algún ningún dos tres es son fue era ser está están tiene tienen hay debe puede
    hace va viene lee abre guarda cierra envía recibe usa muestra pierde falla devuelve genera acepta niega necesita permite contiene depende corrige llama espera corre pasa archivo fichero clave código error fallo rutina paquete servicio regla
    línea análisis versión aviso equipo panel contraseña red dato texto tabla valor pedido cliente cuenta página carpeta prueba carga copia lista cola mes día hora semana""",
}
WORDS = {k: v.split() for k, v in WORDS.items()}
PLACES = ["New York", "Los Angeles", "San Francisco", "São Paulo", "Rio de Janeiro", "Buenos Aires", "Hong Kong", "Tel Aviv", "Cape Town", "North America", "South Asia", "Western Europe", "United Kingdom", "Porto Alegre", "Las Palmas", "Costa Rica", "El Salvador", "Nova Lima", "Santa Cruz"]
PRODUCTS = ["Apache Kafka", "Google Chrome", "Visual Studio", "Red Hat", "Spring Boot", "Ruby on Rails", "Internet Explorer", "Open Policy Agent", "Active Directory", "Amazon Web Services", "Docker Compose", "Common Weakness Enumeration", "Pull Request", "Release Notes", "Access Control", "Security Advisory", "Cross Site Scripting", "Known Issues", "Root Cause", "Next Steps", "Change Log", "Unit Tests", "Code Review", "Quick Start", "Merge Request", "Nota Técnica", "Controle de Acesso", "Guia Rápido", "Causa Raiz", "Próximos Passos", "Control de Acceso", "Notas de la Versión", "Primeros Pasos", "Causa Principal"]

# Kinds of streets, and names that streets have.
STREET_KINDS = "Street St. St Avenue Ave Ave. Road Rd Rd. Lane Ln Drive Dr. Court Ct Close Way Place Square Terrace Boulevard Blvd Crescent Parade Row Hill Mews Gardens".split()
STREET_STEMS = "Church High Station Park Victoria King's Queen's Albert Mill Bridge North South East West Green Manor School Spring Chapel Grange Elm Oak Ash Cherry Chestnut Maple Lime Cedar Walnut Gresham Baker Regent Oxford Cambridge Lincoln Washington Madison Franklin Jefferson Highland Lakeview Riverside Sunset Meadow Orchard Hillcrest Woodland Ferry Harbour Market Castle".split()
STREET_FIRST = "oak elm ash wood field mill stone brook hazel fern fox raven hill lake moor salt copper silver gold white black old long broad clay sand cross bridge thorn larch birch heath rose kings".split()
STREET_LAST = "bank field hill wood mill ford gate path bridge moor marsh fold pot side well view dale mere croft grove crest stead pole".split()
PT_KINDS = ["Rua", "R.", "Avenida", "Av.", "Travessa", "Tv.", "Praça", "Largo", "Alameda", "Estrada", "Rodovia", "Beco", "Ladeira", "Calçada"]
PT_NAMES = ["das Acácias", "dos Pinheiros", "Sete de Setembro", "XV de Novembro", "da Liberdade", "do Carmo", "da Boa Vista", "Almirante Reis", "Dom Pedro II", "Marechal Deodoro", "do Sol", "da Paz", "Santa Clara", "São Bento", "dos Bandeirantes", "Brasil", "Paulista", "Garrett", "do Salgueiro", "da Saudade", "Nova", "Velha da Igreja", "do Poço Seco", "dos Moinhos"]
ES_KINDS = ["Calle", "C/", "Avenida", "Avda.", "Av.", "Paseo", "Pº", "Plaza", "Pza.", "Camino", "Ronda", "Carretera", "Travesía", "Callejón", "Cuesta", "Glorieta"]
ES_NAMES = ["de Alcalá", "Gran Vía", "de la Constitución", "de los Reyes", "del Prado", "de Cervantes", "Goya", "Velázquez", "del Carmen", "de San Juan", "Colón", "de la Paz", "del Sol", "de las Flores", "de los Olivos", "Ancha", "Real", "del Río", "de la Fuente Vieja", "del Horno", "de los Molinos", "Cruz Alta", "de la Torre", "de Toledo"]

# Public formats of telephone and identity numbers (d a digit from 2, 0 any digit, ? a letter) and what stands before the latter.
PHONES = """+1 (ddd) 555-0000|+1 ddd 555 0000|+1-ddd-555-0000|+1.ddd.555.0000|1-ddd-555-0000|+1ddd5550000|(ddd) 555-0000|(ddd)555-0000|ddd-555-0000|ddd.555.0000|ddd 555 0000|+44 dddd 000000|+44 (0)dddd 000 000|(0dddd) 000000|(0dddd) 000-000|0dddd 000000|0dddd 000 000|+44 dddd 000 000
+34 6dd 000 000|+34 9dd 00 00 00|(+34) 6dd-000-000|0034 9dd 000 000|6dd 000 000|6dd 00 00 00|9dd-000-000|+34-6dd-000-000|+55 (dd) 9dddd-0000|+55 dd 9dddd 0000|+55 dd 9dddd-0000|(dd) 9dddd-0000|(dd) dddd-0000|dd 9dddd-0000|0dd 9dddd-0000|0dd 9dddd.0000|(0dd) 9dddd-0000|+351 9dd 000 000|+49 dd 00000000|+33 6 dd 00 00 00""".replace("\n", "|").split("|")
IDS = """SSN=000-00-0000|SSN=000 00 0000|SSN:=000-00-0000|SSN=000000000|social security number=000-00-0000|social security number=000000000|Social Security No.=000 00 0000|soc. sec. no.=000-00-0000|soc. sec. no.=000000000|soc. sec. no.=000 00 0000|CPF=000.000.000-00|CPF:=000.000.000-00|CPF nº=00000000000|CPF=000 000 000 00|CPF=000.000.000/00|CPF número=00000000000|inscrito no CPF sob o nº=000.000.000-00|CPF=00000000000|DNI=00000000?|DNI:=00000000-?|DNI nº=00000000 ?|D.N.I.=00000000?|documento de identidad=00000000?|documento nacional=X0000000 ?|NIF=00000000-?|NIF:=00000000?|NIE=X0000000?|NIE:=Y0000000-?|NIE=X-0000000-?|NIE=Z0000000 ?|NINO=?? 00 00 00 ?|NINO=??000000?|National Insurance number=??000000?|National Insurance number=?? 00 00 00 ?|national id=??000000?|tax id=??000000?|tax id=000-00-0000|tax number=00000000?|passport=?00000000|passport=??0000000|passport no.=??0000000|Passport:=??0000000|passport number=?0000000|passaporte=??000000|pasaporte=???000000""".split("|")
IDS = [tuple(x.split("=")) for x in IDS if "???" not in x]

# Sentences.  N name, E e-mail, P telephone, A/B/C address in English, Portuguese, Spanish, L I label and identity number;
# w thing, a adjective, X product name, S made-up word, T place, V known product or heading, p package, v version, R rule, G repository, Z other number; ~ is a line end.
POSITIVE = """I spoke with {N} yesterday about the {w} {w}.|My colleague {N} wrote this runbook.|You can reach {N} on {P} after lunch.|Yours sincerely, {N}|Kind regards,~{N}|Best, {N}~{P}|Hello {N},~thank you for the {w}.|Dear {N}, we received your {w} on Monday.|{N} and {N} are on call this week.|{N} will take over from {N}.
Talk to {N} or {N} before changing the {w}.|Question from {N}: who owns the {w}?|{N} joined the {a} {w} group in {T}.|{N} discovered this while testing {X}.|Credit goes to {N} for finding it.|Many thanks to {N}, who sent us a sample.|Found by {N} and {N}.|Author: {N}|Author: {N} <{E}>|Maintainer: {N} <{E}>|By {N} ({E})|Committer: {N} <{E}>|From: {N} <{E}>~To: {E}~Subject: {w} {w}
Cc: {E}, {E}|Reply to {E} with the {w} attached.|Send the {w} to {E} and to {E}.|The mailbox {E} is no longer read.|For help write {E}.|user {E} logged in from {T}|owner={E}|login: {E} ({N})|support <{E}>|notify: ["{E}", "{E}"]|Our office moved to {A} last week.|Visitors should go to {A} and ask for {N}.|{N} lives at {A}.|Ship the {w} to {N}, {A}.|Deliver to: {A}|Billing address: {A}|Pick it up at {A} before six.|The customer of {A} complained.|residence: {A}, phone: {P}
The leaked row reads {N}, {A}, {P}.|A record with the name {N}, {L} {I} and home {A} was exposed.|One row showed {N} with {L} {I}.|We saw {L} {I} in the output.|The screenshot has {L} {I} next to {P}.|{L} {I} belongs to {N}.|{L} {I}|{L}: {I}|Contents: {L} {I}, {E}, {P}|Please call {P}.|Phone {P} or e-mail {E}.|Tel. {P}|Tel: {P}, fax: {P}|Mobile {P}, ext. 204|emergency contact: {N}, {P}|hotline {P} is staffed all night|texted {P} about the {w}|whatsapp {P}
# ask {N} first|// {N} knows why, call {P}|/* {N}, {P}: do not touch */|// TODO({N}): remove|# contact: {E}|name,email,phone~{N},{E},{P}~{N},{E},{P}|name|mail|phone~{N}|{E}|{P}|{N};{E};{P}|{N}\t{E}\t{P}|{"full_name": "{N}", "mail": "{E}", "phone": "{P}"}|{"person": {"name": "{N}", "address": "{A}"}}|<name>{N}</name><mail>{E}</mail>|INSERT INTO people (name, mail) VALUES ('{N}', '{E}');|VALUES ('{N}', '{P}', '{A}');|customer: "{N}"~id: "{I}"|name = "{N}"|print('{N}', '{E}')|send_mail("{E}", body)|assignee: {N}|reviewer: {N}|Reported-by: {N} <{E}>|Tested-by: {N} <{E}>|Acked-by: {N}
{N} approved it.|{N} disagreed.|{N} has left the company.|{N} is the data owner; {N} is the deputy.|{N} (security) and {N} (legal) were informed.|Mr. {N} called twice.|Mrs. {N} asked for deletion.|Dr. {N} signed the statement.|Prof. {N} gave a talk on {w}s.|Ms. {N} of {T} wrote to {E}.|according to {N}, nothing was lost|as told by {N}|the account of {N} was locked|{N}'s laptop was stolen|interview with {N}|- {N}: prepared the {w}|* {N} <{E}>|1. {N}, {P}|approved by {N} on Friday|signed: {N}|witness {N}, {A}|held by {N}|taken by {N}, cc {E}|driver {N} reached {A} at noon|the {w} of {N} and {N} was visible
later {N} closed the case|then {N} again|see also {N}|{N} once more|it was {N}
Falei ontem com {N} sobre o {w}.|A colega {N} escreveu o roteiro.|Obrigado a {N} pelo aviso.|Quem cuida disso é {N}.|{N} e {N} estão de plantão.|Prezada {N}, recebemos o pedido.|Atenciosamente,~{N}|Autor: {N} <{E}>|Contato: {N}, {P}|Ligue para {P}.|Telefone: {P}|Fone {P}, e-mail {E}|Escreva para {E}.|Mande o arquivo para {E} e avise {N}.|O senhor {N} ligou de novo.|A doutora {N} assinou o laudo.|{N} mora na {B}.|Endereço: {B}|Entregue na {B}, falar com {N}.|A encomenda foi para {B}.|O cliente {N}, {L} {I}, reclamou.|Vazou o cadastro de {N}, {L} {I}, {B}.|Aparece {L} {I} na saída.|{L} {I}|nome;endereço~{N};{B}|nome: {N}~telefone: {P}|# falar com {N} antes|{"nome": "{N}", "fone": "{P}", "email": "{E}"}|aprovado por {N}|segundo {N}, nada se perdeu|responsável: {N}|depois {N} encerrou o chamado|conta de {N} bloqueada|Sr. {N} e Sra. {N}|remetente: {N}, {B}
Ayer hablé con {N} sobre el {w}.|La compañera {N} redactó la guía.|Gracias a {N} por avisar.|De esto se ocupa {N}.|{N} y {N} están de guardia.|Estimado {N}: recibimos su solicitud.|Un saludo,~{N}|Autora: {N} <{E}>|Contacto: {N}, {P}|Llame al {P}.|Teléfono: {P}|Tel. {P}, correo {E}|Escríbanos a {E}.|Envíe el archivo a {E} y avise a {N}.|El señor {N} llamó otra vez.|La doctora {N} firmó el informe.|{N} vive en {C}.|Dirección: {C}|Entregar en {C}, preguntar por {N}.|El paquete fue a {C}.|El cliente {N}, {L} {I}, se quejó.|Se filtró la ficha de {N}, {L} {I}, {C}.|Aparece {L} {I} en la salida.|{L} {I}|nombre;dirección~{N};{C}|nombre: {N}~teléfono: {P}|# hablar antes con {N}|{"nombre": "{N}", "tel": "{P}", "correo": "{E}"}|aprobado por {N}|según {N}, no se perdió nada|responsable: {N}|luego {N} cerró el caso|cuenta de {N} bloqueada|Sr. {N} y Sra. {N}|remitente: {N}, {C}"""

NEGATIVE = """{X} reads the {w} from disk.|{X} writes {w}s to the {a} {w}.|{X} calls {X} over the internal network.|{X} was deployed in {T}.|The {X} {w} was renamed.|The {X} team meets on Tuesday.|We moved {X} to the {a} cluster.|Version {v} of {X} is affected.|{X} {v}|{X}: {w} missing|{X} has no {w} check.|{X} and {X} share a {w}.|between {X} and {X}|in {X} the {w} is optional|with {X} enabled, {w}s are kept|inside {X}|{X} crashed after 40 minutes.|{X} handles the {w}s of {X}.|Is {X} affected?|Does {X} still need {w}?|We like {X} because it is {a}.|because {X} trusts every {w}|only {X} rejects it|but {X} accepts empty {w}s|Project {X}, phase 2|incident 118, {X}, 2021|{X} stores {w}s in clear text.|{X} never checks who sent the {w}.|The manual of {X}, page 31|upgrade {X} first|Codename: {X}|service: {X}|target = {X}|owner team: {X}|- {X}: fixed the {w}|* {X} is deprecated
{S} accepts any {w}.|{S} and {p} talk over HTTP.|{S} checks {w}s twice.|Why does {S} need a {w}?|In {S}, {w}s are {a}.|{S} {v} ships with {p}.|the {S} plugin|{S} Corporation released a fix.|{S} Labs answered.|{V}|## {V}|{V}: see below|{V} {v} was installed.|This affects {V} users in {T}.|The conference takes place in {T}.|Our region is {T}.|hosted in {T} and {T}
The {a} {w} has 14 {w}s.|A {w} of the {w} was {a}.|Every {w} needs a {w} and a {w}.|Do not log the {w}.|Set the {w} to 30 seconds.|No {w} was found for {w}.|Two {w}s expired on 2022-03-04.|The scan took 12 minutes and found 340 issues.|Severity: High|Status: Open|Category: Injection|critical 4, high 12, medium 33|{R} fired on src/{w}/{w}.py.|Suppress {R} in lib/{w}.ts until next week.|[{R}] {w}/{w}.go:{Z}|CVE-2021-44228 and CWE-79 apply.|fixed in {p} {v}|install {p}=={v}|pinned {p}@{v}, {p}@{v}|npm i @types/{w}|import {w} from '{p}'|from {w} import {w}_{w}|def {w}_{w}(self, {w}):|function {w}({w}, {w}) {|return {w}.{w}({w});|public class {S} extends {S} {|if ({w} == null) throw new {S}Exception();|SELECT {w}, {w} FROM {w} WHERE id = {Z};|const {w} = require("{p}");|@app.route("/{w}")|@cached|<div class="{w}">|```python|```|{w}: {w}~{w}: [{w}, {w}]|Dear all,|Hi team,|Hello everyone, the {w} is ready.|Best regards|Thank you for reading.|Street lamps are {a}.|the street field is empty|address of the {w} buffer|phone numbers are masked|name and e-mail are hashed|The name field must not be empty.|the road to {w}s is long|way 12 of 40|court of the {w}|place 3, row 8|{G}|clone {G}|git remote add origin {G}|ssh://git@host.example/{w}.git|https://{w}.example/{p}/{v}
build {Z}|order {Z} shipped|ticket {Z}|commit {Z}|serial {Z}|invoice {Z}|tracking {Z}|epoch {Z}|offset {Z}|range {Z}|ids {Z} to {Z}|port {Z}|job {Z} took {Z} ms|account ending in {Z}|part no. {Z}|isbn {Z}|sku {Z}|lot {Z}|case {Z}|sample {Z} of shard {Z}|batch {Z}: {Z} rows|code {Z}|ref {Z}|sum {Z}|pattern [0-9]{3}-[0-9]{2}-[0-9]{4}|/^\\d{3}-\\d{3}-\\d{4}$/|listening on 192.0.2.10:8080|10.0.0.1/24|sha1 da39a3ee5e6b4b0d3255bfef95601890afd80709|{Z}|[{Z}, {Z}, {Z}]|{w}_id={Z}|2020/11/05 13:45:12|v{v}-{Z}|0x7ffee3 {Z}|lines 12-48|pages 100-120|1 234 567 rows|99.95 % of {Z}|timeout={Z}
{X} lê o {w} do disco.|{X} grava {w}s no {w}.|O serviço {X} caiu.|A equipe {X} cuida do {w}.|{X} não confere o {w}.|A versão {v} de {X} foi retirada.|porque {X} aceita tudo|Não registre o {w}.|O {w} expirou em 2021-06-30.|Severidade: alta|Regra {R} em {w}.|A regra {R} disparou 12 vezes.|O contêiner roda com privilégios.|A rua estava vazia.|O nome é obrigatório.|pedido {Z}|protocolo {Z}|lote {Z}|Olá a todos,|Obrigado.|{V}|Este {w} é {a}.|faixa {Z}|processo {Z} encerrado
{X} lee el {w} del disco.|{X} guarda {w}s en el {w}.|El servicio {X} cayó.|El equipo {X} cuida del {w}.|{X} no comprueba el {w}.|La versión {v} de {X} se retiró.|porque {X} lo acepta todo|No registre el {w}.|El {w} caducó el 2021-06-30.|Gravedad: alta|Regla {R} en {w}.|La regla {R} saltó 12 veces.|El contenedor corre con privilegios.|La calle estaba vacía.|El nombre es obligatorio.|pedido {Z}|expediente {Z}|lote {Z}|Hola a todos:|Gracias.|{V}|Este {w} es {a}.|rango {Z}|proceso {Z} cerrado"""


NEGATIVE += """
SELECT a.{w}, b.{w} FROM {w} a JOIN {w}_{w} b ON a.id = b.{w}_id WHERE b.{w} > {Z}|LEFT JOIN {w} b ON b.{w}_id = a.id AND a.{w} IS NOT NULL ORDER BY a.{w} LIMIT 50|UPDATE {w} SET {w} = {w} + 1 WHERE {w}_id = {Z}|log.info("{w} %s took %d ms", {w}_{w}, 640)|print("{w} %d of %d", {w}, {w})|{w}.{w}("{w}", {Z})|for {w} in {w}s[:20]:|request.headers.get("X-{S}-Token")|uuid {U}|span {U}.|request {U} failed|{U}|diff +120 -45|at 0x{H} +{Z}|crash at 0x{H} +0000 0000|{H}|digest {H}|stack {S}.{w}({S}.java:88)|{w}/{w}.rb:{Z}|THE {w} OF THE {w} WAS {a}|A {S} GUARD COUNTS 14 {w}S|In {S} there are two {a} {w}s.|{S} may open it before {S}.|Neither {S} nor {S} may read the {w}.|O {w} de {S} soma 12 lotes.|El {w} de {S} suma 12 lotes.|{R} misses {X}.|trace {U}, {w} {Z}"""
POSITIVE += """
'{l}': '{I}'|{'{l}': '{I}', 'name': '{N}'}|{"{l}": "{I}"}|{l}={I}|person = {'nome': '{N}', '{l}': '{I}'}|user = {"name": "{N}", "{l}": "{I}", "mail": "{E}"}|{l}: {I}~name: {N}|row({N}, {l} {I})|write to {N} at {E} today|tell {N} at {P} today|{N} ({P}) knows|{N} ({E}) knows|{N} <{E}> wrote|found in {A} by {N}|{N}, {E}, {P}, {L} {I}|a letter for {N} to {A}|avise {N} em {E} hoje|avise a {N} en {E} hoy"""


# What stands before and after persons and addresses in running text.
BEFORE = {
    "en": "signed-off-by:|co-authored-by:|reviewed-by:|acked-by:|reported-by:|suggested-by:|by|by|from|to|for|with|and|or|of|reported by|sent by|written by|signed by|found by|contact|please ask|ask|call|ring|tell|thank|thanks to|meet|write to|speak to|talk to|Dr.|Dr.|Mr.|Ms.|Mrs.|Prof.|name:|holder:|owner:|maintainer:|user:|author:|customer:|the row of|record of|account of|data of|file of|care of|c/o|attn.|copy to|on behalf of|according to|when|because|that|said|//|#|*|-|>|name =|\"name\": \"|'|(|",
    "pt": "por|por|de|para|com|e|ou|relatado por|enviado por|escrito por|assinado por|achado por|falar com|ligue para|escreva a|avise|chame|agradeça a|Dr.|Dra.|Sr.|Sra.|Prof.|nome:|titular:|autor:|cliente:|morador:|a linha de|registro de|ficha de|conta de|dados de|a/c|aos cuidados de|cópia para|em nome de|segundo|quando|porque|que|//|#|-|nome =|'nome': '|",
    "es": "por|por|de|a|para|con|y|o|notificado por|enviado por|escrito por|firmado por|hallado por|hable con|llame a|escriba a|avise a|pregunte a|gracias a|Dr.|Dra.|Sr.|Sra.|Prof.|nombre:|titular:|autor:|cliente:|vecino:|la fila de|registro de|ficha de|cuenta de|datos de|a la atención de|copia a|en nombre de|según|cuando|porque|que|//|#|-|nombre =|'nombre': '|",
}
AFTER = {
    "en": "said|asked|wrote|called|reported|replied|agreed|noticed|signed|answered|explained|warned|wants|knows|lives|works|will|was|is|has|had|and {N}|or {N}|at {E}|({E})|<{E}>|({P})|, {P}|; {E}; {P}|, {L} {I}|;{E};{P}|,{E},{P}|, {A}|', '{E}'|\", \"mail\": \"{E}\"|on {P}|before you|before|after|through|in|on|today|again|.|,|:|'s",
    "pt": "disse|pediu|escreveu|ligou|relatou|respondeu|avisou|notou|assinou|explicou|quer|sabe|mora|trabalha|vai|foi|é|tem|e {N}|em {E}|({E})|<{E}>|({P})|, {P}|;{E};{P}|, {L} {I}|, {L} {I}, {B}|, {B}|', 'email': '{E}'|no {P}|antes|depois|pelo|em|hoje|.|,",
    "es": "dijo|pidió|escribió|llamó|notificó|respondió|avisó|notó|firmó|explicó|quiere|sabe|vive|trabaja|va|fue|es|tiene|y {N}|en {E}|({E})|<{E}>|({P})|, {P}|;{E};{P}|, {L} {I}|, {L} {I}, {C}|, {C}|', 'correo': '{E}'|al {P}|antes|después|mediante|en|hoy|.|,",
}
WEAK = frozenset("by from to for with and or of when because that said // # * - > por de para com e ou quando porque que a con y o cuando".split()) | {""}
AT_STREET = {
    "en": "at|to|from|near|is|lives at|living at|home|home:|address:|sent to|moved to|go to|goes to|of|strike|remove|, ", "pt": "na|na|em|para a|da|mora na|reside na|residente na|endereço:|na sede,|entregar na|, ", "es": "en|en|a|de|vive en|reside en|con domicilio en|domicilio:|dirección:|entregar en|enviar a|, ",
}
AFTER_STREET = {"en": ".|,|; call {P}|, {N}|, c/o {N}|for {N}|for {N}.|and {N}|by {N}|with {N}.|until noon|on Monday|from the {w}|before|and|in the|,{P}", "pt": ".|,|; ligue {P}|, {N}|, a/c {N}|, aos cuidados de {N}|, aos cuidados de {N}.|para {N}|com {N}|até meio-dia|antes|e|de", "es": ".|,|; llame al {P}|, {N}|, a la atención de {N}|, a la atención de {N}.|para {N}|con {N}|hasta mediodía|antes|y|de"}


def _split(block: str) -> list[str]:
    return list(dict.fromkeys(t.replace("~", "\n") for line in block.split("\n") for t in line.split("|") if t))


def _fill(rng: random.Random, pattern: str, letters: str = "ABCDEFGHJKLMNPRSTVWXYZ") -> str:
    return "".join(rng.choice("0123456789") if c == "0" else rng.choice("23456789") if c == "d" else rng.choice(letters) if c == "?" else c for c in pattern)


#: Words that a street's name begins or ends with, in lower case without full stops.
STREET_WORDS = frozenset(w.lower().strip(".") for w in (*STREET_KINDS, *PT_KINDS, *ES_KINDS)) - {"row", "way", "place", "close", "c/"} | {"c"}
#: Words that are no names by themselves, in lower case.
COMMON = frozenset(w for ws in (*WORDS.values(), ADJECTIVES, NOUNS, THINGS) for w in ws)


class Maker:
    """Draws documents.  ``held``: from the sentences and names that training never sees."""

    def __init__(self, seed: int = 7, held: bool = False) -> None:
        self.rng = random.Random(seed)
        mine = lambda xs: [x for n, x in enumerate(xs) if (n % 5 == 4) == held]
        self.given, self.family = mine(GIVEN), mine(FAMILY)
        self.positive, self.negative = mine(_split(POSITIVE)), mine(_split(NEGATIVE))
        self.cast: list[tuple[str, str]] = []

    def made(self, ends: list[str] | None = None, least: int = 1) -> str:
        r = self.rng
        return ("".join(r.choice(SOUNDS) for _ in range(r.randint(least, 2))) + (r.choice(ends) if ends else r.choice("nrxlkds"))).capitalize()

    def person(self) -> tuple[str, str]:
        r = self.rng
        given = r.choice(self.given) if r.random() < 0.5 else self.made(GIVEN_ENDS)
        family = r.choice(self.family) if r.random() < 0.5 else self.made(FAMILY_ENDS)
        return given, family + ("-" + (r.choice(self.family) if r.random() < 0.5 else self.made(FAMILY_ENDS)) if r.random() < 0.1 else "")

    def name(self, bare: bool = False) -> str:
        r = self.rng
        if not self.cast or r.random() < 0.5:
            self.cast.append(self.person())
        given, family = r.choice(self.cast[-3:])
        kind = r.random()
        if kind < 0.12:
            text = f"{given[0]}. {family}"
        elif kind < 0.26:
            text = f"{family.upper() if r.random() < 0.5 else family}, {given}"
        elif kind < 0.36:
            text = f"{given} {r.choice('ABCDEFGHIJKLMNOPRSTVW')}. {family}"
        elif kind < 0.44:
            text = f"{given} {r.choice(PARTICLES)} {family}"
        elif kind < 0.5:
            text = f"{given} {r.choice(self.family)} {family}"
        elif kind < 0.54:
            text = f"{given} {family.upper()}"
        else:
            text = f"{given} {family}"
        case = r.random()
        return text.lower() if case < 0.13 and not bare else text.upper() if case < 0.18 else text

    def email(self) -> str:
        r = self.rng
        given, family = (x.lower() for x in self.person())
        local = r.choice([f"{given}.{family}", f"{given}_{family}", f"{given[0]}{family}", f"{family}{r.randint(0, 99)}", f"{family}.{given[0]}", f"{given}+{r.choice(THINGS)}", r.choice(THINGS)])
        host = r.choice(["", "mail.", "post.", "corp."]) + r.choice([self.made().lower(), r.choice(NOUNS), f"{r.choice(ADJECTIVES)}-{r.choice(NOUNS)}"]) + r.choice([".com", ".org", ".net", ".example", ".test", ".com.br", ".es", ".pt", ".co.uk", ".io", ".invalid"])
        text = f"{local}@{host}".replace("'", "")
        kind = r.random()
        if kind < 0.12:
            at, dot = r.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "."), ("[at]", "[dot]"), (" at ", " dot "), ("＠", "."), (" [at] ", ".")])
            return text.replace("@", at).replace(".", dot)
        return text.upper() if kind < 0.15 else text

    def phone(self) -> str:
        return _fill(self.rng, self.rng.choice(PHONES))

    def id_number(self) -> tuple[str, str]:
        label, pattern = self.rng.choice(IDS)
        return label, _fill(self.rng, pattern)

    def street(self) -> str:
        r = self.rng
        kind = r.random()
        return r.choice(STREET_STEMS) if kind < 0.4 else (r.choice(STREET_FIRST) + r.choice(STREET_LAST)).capitalize() if kind < 0.8 else r.choice(["", self.made() + " "]) + self.made(FAMILY_ENDS)

    def address(self) -> str:
        r = self.rng
        n = f"{r.randint(1, 9999 if r.random() < 0.3 else 300)}{r.choice(['', '', '', '', 'A', 'B', 'c'])}"
        return f"{n} {r.choice(['', '', '', '', 'North ', 'S. ', 'East ', 'W. ', 'Old '])}{self.street()} {r.choice(STREET_KINDS)}{r.choice(['', '', '', f', Apt {r.randint(1, 99)}', f', Flat {r.randint(1, 40)}', f', Suite {r.randint(100, 999)}', f' Apt. {r.randint(1, 99)}', f', Unit {r.randint(1, 20)}'])}"

    def pt_address(self) -> str:
        r = self.rng
        name = r.choice(PT_NAMES) if r.random() < 0.5 else r.choice(["", "da ", "do ", "das ", "dos "]) + r.choice([self.made(FAMILY_ENDS), f"{self.made()} {self.made(FAMILY_ENDS)}", r.choice(self.family)])
        return f"{r.choice(PT_KINDS)} {name}{r.choice([', ', ', ', ' ', ', nº ', ', n.º '])}{r.randint(1, 2900)}{r.choice(['', '', f', apto {r.randint(1, 99)}', f', apt. {r.randint(1, 99)}', f', bloco {r.choice('ABC')}', f' - ap {r.randint(1, 99)}'])}"

    def es_address(self) -> str:
        r = self.rng
        name = r.choice(ES_NAMES) if r.random() < 0.5 else r.choice(["", "de ", "del ", "de la ", "de los "]) + r.choice([self.made(FAMILY_ENDS), f"{self.made()} {self.made(FAMILY_ENDS)}", r.choice(self.family)])
        return f"{r.choice(ES_KINDS)} {name}{r.choice([', ', ', ', ' ', ', nº ', ', n.º ', ', núm. '])}{r.randint(1, 2900)}{r.choice(['', '', ', 2.º A', ', 3º B', f', piso {r.randint(1, 9)}', ', bajo'])}"

    def product(self) -> str:
        r = self.rng
        a, b = r.choice(ADJECTIVES), r.choice(NOUNS)
        kind = r.random()
        return f"{a.capitalize()} {b.capitalize()}" if kind < 0.8 else f"{r.choice(NOUNS).capitalize()} {b.capitalize()}" if kind < 0.9 else f"{a.capitalize()}{b.capitalize()}" if kind < 0.95 else f"{self.made()} {r.choice(THINGS).capitalize()}"

    def number(self) -> str:
        r = self.rng
        if r.random() < 0.4:
            return _fill(r, "0" * r.randint(3, 13))
        return r.choice("--- ./").join(_fill(r, "0" * r.randint(2, 5)) for _ in range(r.randint(2, 4))) if r.random() < 0.8 else _fill(r, r.choice(["0000-0000-0000-0000", "000-00-0000", "000 000 000", "00000-0000", "000-000-0000", "??-000000", "?000000", "+0000 0000", "+000 000", "+00000 0000"]))

    def package(self) -> str:
        r = self.rng
        return r.choice([self.made().lower(), f"{r.choice(ADJECTIVES)}-{r.choice(NOUNS)}", f"{self.made().lower()}-{r.choice(THINGS)}", f"{r.choice(THINGS)}-{r.choice(NOUNS)}"])

    def sentence(self, template: str) -> tuple[str, list[tuple[int, int, str]]]:
        r, out, spans, pending = self.rng, "", [], None
        hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
        slots = {
            "H": lambda: hexa(r.choice([8, 12, 32, 40])), "U": lambda: "-".join(map(hexa, (8, 4, 4, 4, 12))),
            "w": lambda: r.choice(THINGS), "a": lambda: r.choice(ADJECTIVES), "X": self.product, "S": lambda: self.made(least=2), "T": lambda: r.choice(PLACES), "V": lambda: r.choice(PRODUCTS), "p": self.package,
            "v": lambda: f"{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 50)}", "R": lambda: _fill(r, r.choice(["???-000", "??-000", "????-0"])), "Z": self.number,
            "G": lambda: r.choice([f"git@{self.made().lower()}.example:{r.choice(THINGS)}/{r.choice(THINGS)}.git", f"https://{r.choice(THINGS)}@{self.made().lower()}.example/{r.choice(THINGS)}.git"]),
        }
        typed = {"N": ("name", self.name), "n": ("name", lambda: self.name(True)), "E": ("email", self.email), "P": ("phone", self.phone), "A": ("address", self.address), "B": ("address", self.pt_address), "C": ("address", self.es_address)}
        at = 0
        while at < len(template):
            slot = template[at + 1] if template[at] == "{" and template[at + 2 : at + 3] == "}" and template[at + 1].isalpha() else None
            if slot is None:
                out += template[at]
                at += 1
                continue
            at += 3
            if slot in "Ll":
                label, pending = self.id_number()
                while slot == "l" and (len(label) > 8 or not label[0].isalpha()):
                    label, pending = self.id_number()
                out += label if slot == "L" else label.lower().strip(":").replace(" ", "_").replace("_nº", "")
                continue
            if slot == "I":
                kind, text, pending = "id", pending or self.id_number()[1], None
            elif slot in typed:
                kind, make = typed[slot]
                text = make()
            else:
                kind, text = None, slots[slot]()
            if kind:
                spans.append((len(out), len(out) + len(text), kind))
            out += text
        return out, spans

    def babble(self, slot: str | None) -> str:
        """A template of words put together at random in one language, a slot somewhere in it."""
        r = self.rng
        words = WORDS["pt" if slot == "B" else "es" if slot == "C" else r.choice(["en", "en", "pt", "es"])]
        one = lambda: r.choice(words) if r.random() < 0.75 else r.choice(["{w}", "{w}s", "{a}", "{w}_{w}", "`{w}`", "{w}.{w}", "{w}/{w}.py", "{p}", "{v}", str(r.randint(2, 999)), str(r.randint(2, 9999)), "{R}", "{X}", "{S}", "req.{w}", "{w}()"])
        out = [one() for _ in range(r.randint(3, 12))]
        if slot:
            out.insert(r.randint(0, len(out)), "{L} {I}" if slot == "I" else "{" + slot + "}")
        out = [w + (r.choice([",", ",", ":", ";"]) if r.random() < 0.08 else "") for w in out]
        if r.random() < 0.7 and out[0][0].isalpha():
            out[0] = out[0].capitalize()
        return " ".join(out) + r.choice([".", ".", ".", "", "?", "!"])

    def cued(self) -> str:
        """A template of a person or an address between what usually stands around it."""
        r = self.rng
        lang, person = r.choice(["en", "en", "pt", "es"]), r.random() < 0.7
        slot = "N" if person else {"en": "A", "pt": "B", "es": "C"}[lang]
        before = r.choice((BEFORE if person else AT_STREET)[lang].split("|"))
        if person and before in WEAK:
            slot = "n"  # nothing but its capitals tells a name here
        after = r.choice((AFTER if person else AFTER_STREET)[lang].split("|"))
        if before == "" or r.random() < 0.5:
            before = before.capitalize()
        words = lambda n: " ".join(r.choice(WORDS[lang]) if r.random() < 0.8 else "{w}" for _ in range(r.randint(0, n)))
        lead = words(5)
        glue = "" if before[-1:] in ("'", '"', "(") else " "
        text = f"{lead.capitalize()}{' ' if lead else ''}{before if not lead else before[:1].lower() + before[1:] if before[:1].isalpha() and before[-1:] != '.' else before}{glue if before else ''}{{{slot}}}"
        return f"{text}{'' if after[0] in '.,;:' + chr(39) else ' '}{after} {words(6)}{r.choice(['.', '', '.'])}"

    def subject(self) -> str:
        """A template of a product's name where a person's could stand."""
        r = self.rng
        words = WORDS[r.choice(["en", "en", "pt", "es"])]
        before = r.choice(["", "", "", "- ", "* ", "by ", "from ", "to ", "for ", "with ", "and ", "of ", "because ", "that ", "in ", "component ", "service ", "project ", "o ", "a ", "el ", "la ", "de ", "com ", "con ", "por ", "que ", "porque "])
        lead = " ".join(r.choice(words) for _ in range(r.randint(0, 4)))
        return f"{lead.capitalize()}{' ' if lead else ''}{before}{{X}} {' '.join(r.choice(words) if r.random() < 0.8 else '{w}' for _ in range(r.randint(1, 7)))}."

    def record(self) -> str:
        """A template of rows of fields."""
        r = self.rng
        sep = r.choice([";", ";", ",", "\t", " | ", ", ", "; "])
        fields = r.sample(["{N}", "{E}", "{P}", r.choice(["{A}", "{B}", "{C}"]), "{w}", "{v}"], r.randint(2, 4))
        fields = fields if any(f in ("{N}", "{E}", "{P}") for f in fields) else ["{N}", *fields]
        if r.random() < 0.6:
            fields.sort(key=lambda f: f != "{N}")
        head = sep.join(r.choice(["name", "mail", "phone", "id", "{w}", "nome", "correo", "tel", "fone"]) for _ in fields) + "\n"
        return (head if r.random() < 0.7 else "") + "\n".join(sep.join(fields) for _ in range(r.randint(1, 4))) + "\n"

    def template(self) -> str:
        r = self.rng
        if r.random() < 0.48:
            kind = r.random()
            return r.choice(self.positive) if kind < 0.35 else self.cued() if kind < 0.7 else self.record() if kind < 0.8 else self.babble(r.choice("nnnnnEPABCI"))
        kind = r.random()
        return r.choice(self.negative) if kind < 0.4 else self.subject() if kind < 0.6 else self.babble(r.choice([None, None, "X", "X", "S", "Z", "Z", "G", "V", "T"]))

    def documents(self, sentences: int = SENTENCES) -> list[tuple[str, list[tuple[int, int, str]]]]:
        """Small texts of a few sentences, one to a line or run together, with a cast of persons who return in other forms of their names."""
        r, docs, made = self.rng, [], 0
        while made < sentences:
            self.cast = []
            parts = [self.sentence(self.template()) for _ in range(r.randint(2, 7))]
            text, spans = "", []
            for s, own in parts:
                lead = r.choice(["", "", "", "", "", "- ", "* ", "> ", f"{r.randint(0, 23):02}:{r.randint(0, 59):02} ", f"{r.randint(1, 9)}. "])
                at = len(text) + len(lead)
                text += lead + s + r.choice([" ", " ", "\n", " \n", "\n\n"])
                spans += [(at + a, at + b, k) for a, b, k in own]
            docs.append((text, spans))
            made += len(parts)
        return docs
