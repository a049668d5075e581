"""Word lists of the personal-information detector: fixed values, folded to lower case.

Names of persons come from two list files of common names, which can be replaced by others; words that are ordinary come
from the vocabulary of the public tokenizer.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from importlib.resources import files
from pathlib import Path

from remitloom.llm.tokens import vocabulary_path

#: Folder with ``given_names.txt`` and ``family_names.txt``: this variable, else the one in the package.
NAMES_VARIABLE = "PERSON_NAMES_PATH"

TITLES = set("mr mrs ms miss mx dr dra sr sra srta srto don doña dona senhor senhora señor señora doctor doctora doutor doutora prof profesor profesora professor sir lady ing lic herr frau madame monsieur".split())
PARTICLES = {"de", "del", "da", "do", "dos", "das", "di", "van", "von", "der", "den", "la", "le", "du", "bin", "al", "los", "las", "ter", "ten", "zu"}
#: Ranks and honours in names of streets.
STREET_HONOURS = {"comandante", "general", "coronel", "capitán", "almirante", "presidente", "doutor", "san", "santa", "santo", "são"}
#: Words in names of banks and firms.
ORGANISATION = set(
    """bank banks banco banca bancos kasse sparkasse caja caixa savings trust mutual cooperative cooperativa union credit holding holdings merchant commercial
    llc ltd inc gmbh lda ag plc corp limited limitada ltda company compañía group grupo partners co co. corporation freight milling textiles pharma timber logistics dairy
    tooling ceramics cables software marine optics paper foods industries systems services solutions consulting insurance seguros capital ventures energy motors airlines
    foundation fundación university universidad universidade ministry ministerio ministério council s.a s.r.l""".split()
)
#: Of these, the ones that stand before the rest of the name.
ORGANISATION_FIRST = {"banco", "banca", "caja", "caixa", "grupo", "compañía", "fundación", "universidad", "universidade", "ministerio", "ministério", "kasse", "sparkasse"}

STREETS_AFTER = "street st road rd avenue ave lane ln court ct drive dr blvd boulevard terrace ter way place pl square sq close crescent cres parkway pkwy highway hwy row mews grove".split()
STREETS_SHORT = {"st", "rd", "ave", "ln", "ct", "dr", "blvd", "ter", "pl", "sq", "cres", "pkwy", "hwy"}
#: Of these, everyday words: in capitals a long run of words before them is no street.
STREETS_EVERYDAY = {"close", "way", "place", "row", "court", "square", "drive", "ct", "pl", "dr", "sq", "grove", "st", "ter"}
STREETS_BEFORE = "calle c/ av avda avenida bv bvar bulevar camino cno pasaje pje paseo plaza carrera cra ruta diagonal callejón ronda rua travessa largo praça praca praceta calçada carretera alameda estrada ladeira beco rambla vía via r trav tv lgo rue".split()
#: Of these, the ones that need a full stop.
STREETS_WITH_DOT = {"r", "trav", "tv", "lgo"}
#: Ends of one-word names of streets.
STREETS_END = ("straße", "strasse", "weg", "platz", "gasse", "allee", "straat", "laan", "gatan", "vägen", "gata")
#: Phrases before an address.
ADDRESS_CUES = """lives at|living at|resides at|residing at|residence|home address|address|posted to|registered at|moved to|mailed to|delivered to|vive en|domicilio|dirección|domiciliado en|se mudó a
residente en|mora em|mora na|mora no|morada|endereço|residente em|mudou-se para""".replace("\n", "|").split("|")

#: Words that stand before "at" without being part of an address, and the last parts of domains after which it may be one.
BEFORE_AT = set("look looked arrive arrived arrives is was are were be been held back up down stay stays stayed meet met work works see seen page pages site online posted published available".split())
TOP_DOMAINS = set("com org net edu gov info biz io example test invalid localhost es pt br mx ar cl co pe uy uk us ca au de fr it ch eu".split())

ID_LABELS = """dni|d.n.i|d.n.i.|documento|documento nacional|documento de identidad|documento de identidade|cuit|cuil|nie|pasaporte|passport|passaporte|ssn|social security
social security number|tax id|tax identification number|tin|itin|ni number|nino|national insurance|national insurance number|id card|identity card|identity number
national id|nif|contribuinte|número de contribuinte|bilhete de identidade|cartão de cidadão|cartão de identidade|rg|cpf|bi|cédula|cédula de identidad|curp|rfc|rut
seguridad social|número de seguridad social|segurança social|driver's licence|driving licence|driver's license""".replace("\n", "|").split("|")

#: Of these, the ones whose numbers begin with letters of the name.
ID_OF_NAME = {"curp", "rfc", "driver's licence", "driving licence", "driver's license"}

PHONE_LABELS = """tel tel. tel: teléfono telefono telefone phone ph fax cell mobile móvil telemóvel celular text call llamar ligar whatsapp dialled dial""".split()
#: A long number right after one of these is no phone.
NUMBER_LABELS = """message mensaje mensagem case caso ticket trámite expediente chamado batch lote reference referencia referência ref alert alerta invoice factura
fatura order orden pedido encomenda account cuenta conta transfer offset line línea linha id message_id client rows shares""".split()
#: Country codes of two digits in the international numbering plan; 1 and 7 have one digit, all others three.
COUNTRY_CODES_2 = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

#: Phrases right before a person's name.
NAME_CUES = """beneficiary|beneficiario|beneficiário|beneficiaria|beneficiária|contact|contacto|contato|ask for|ask|spoke with|spoke to|talked to|according to|forwarded to|transfer to|held by|signed by|reported by|requested by
made out to|payable to|payee|account holder|holder|client|cliente|customer|account of|signature of|neither|nor|hablé con|habló con|falei com|falou com|fale com|a nombre de|em nome de|in the name of|según|segundo|parece ser de
firma de|firmado por|firmado|assinado por|assinado|pago a|pago de|pagamento a|gift for|regalo para|presente para|c/o|on behalf of|attn|attention|dear|estimado|estimada|caro|cara|my name is|mi nombre es|me llamo|meu nome é|i am
kind regards|regards|saludos|atenciosamente|atentamente|sincerely|titular|lo atendió|pedida por|pedido por""".replace("\n", "|").split("|")
#: Phrases right after one.
NAME_FOLLOWS = "says|said|wrote|denies|claims|called|signed|dice que|dijo|niega|firmó|diz que|disse|nega|assinou".split("|")

MONTHS_AND_CURRENCIES = set(
    """january february march april may june july august september october november december enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre janeiro fevereiro março maio junho julho
    setembro outubro novembro dezembro dollar dollars euro euros yen yuan peso pesos real reais pound pounds franc francs ruble rubles rupee rupees shekel riyal bitcoin usd eur""".split()
)
#: Words of running text that the tokenizer's vocabulary lacks or that it has with a capital only: never part of a name.
NO_NAME = set(
    """neither nor either nobody the and or of on in at to for from with by two three a al algo alguien ambos ante antes así atención aunque aún bajo cada casi cierre como con contra copia cual cuando cuenta cuentas cuál de del desde después dice dos durante día días el ella ellas ellos en entre era es esa
    ese eso esta estado estamos este esto están fue fueron ha había hablé habló han hasta hay hola hoy importe la las lo los luego línea lote mañana menos mensaje mensajes mes mi mientras mismo muy más nada ni ningún nos nosotros
    nuestra nuestro nunca o orden otra otro para pendiente pero plazo poco por porque pues quedan que quien quién referencia saldo se sea según ser si sido sin sobre solo son su sus sí también tampoco tarjeta te tiene tienen titular
    todo todos tras tres tu un una uno unos usted ya y às ao aos apenas após até cada caso cliente com como conta contas cópia da das de depois desde do dos durante e ela ele eles em entre era essa esse esta este está eu extrato fatura
    foi foram há isso já lhe mais mas mensagem mensagens mesmo muito na nas nem nenhum no nos nossa nosso não nós num numa o ontem os ou outra outro para pela pelo por porque quando que quem saldo se sem ser seu sua são só também tem
    titular um uma você à é cheque transferencia transferência referência pagamento pago pagos cobro firma cuota factura recibo oficina sucursal horario aviso novedad resumen extracto comprobante comprovante depósito comisión
    january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre
    diciembre lunes martes miércoles jueves viernes sábado domingo janeiro fevereiro março maio junho julho setembro outubro novembro dezembro segunda terça quarta quinta sexta
    dollar dólar pound libra sterling franc franco real reais peso riyal ruble rouble rublo rupee rupia shekel yen yuan euro euros bitcoin cent swiss saudi mexican mexicano canadian australian british brazilian brazil american
    indian israeli russian chinese japanese english spanish portuguese español inglés portugués ach wire swift iban bic usd eur gbp jpy cny inr brl mxn cad aud chf sar rub ils btc
    airport station branch office hotel hospital school church park support service department customer client clients north south east west account accounts agent caller payee holder handle ticket alert batch invoice ref llc
    hello dear thanks regards sincerely saludos atentamente atenciosamente estimado estimada caro cara gracias obrigado obrigada llamar ligar enviar adjuntar anexar responder domicilio morada endereço dirección telefone teléfono
    beneficiary beneficiario beneficiário beneficiaria contact contacto contato passport pasaporte passaporte dni nif nie cuit cuil cpf rg ssn curp rfc tel fax info warn error debug utc gmt""".split()
) | set(ID_LABELS) | set(STREETS_AFTER) | set(STREETS_BEFORE) | STREET_HONOURS


def _names(file: str) -> list[list[str]]:
    folder = os.environ.get(NAMES_VARIABLE)
    where = Path(folder) if folder else files("remitloom.llm").joinpath("data")  # inside a zip as well
    lines = where.joinpath(file).read_text(encoding="utf-8").lower().splitlines()
    return [line.split() for line in lines if line and not line.startswith("#")]


@lru_cache(maxsize=1)
def family_names() -> frozenset[str]:
    return frozenset(w for line in _names("family_names.txt") for w in line if w not in PARTICLES)


@lru_cache(maxsize=1)
def given_names() -> dict[str, str]:
    """Given name -> ``f`` or ``m``; a name listed under both is ``f``."""
    found: dict[str, str] = {}
    for gender, *names in _names("given_names.txt"):
        for name in names:
            found.setdefault(name, gender)
    return found


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> tuple[frozenset[str], frozenset[str]]:
    """Whole words of the public tokenizer's vocabulary: those it has in lower case, and those it has with a capital only."""
    small, capital = set(), set()
    with open(path or vocabulary_path(), "rb") as lines:
        for line in lines:
            word = base64.b64decode(line.split()[0]).decode("utf-8", "ignore")
            if len(word) > 2 and word[0] == " " and word[1:].isalpha():
                word = word[1:]
                if word.islower():
                    small.add(word)
                elif word[0].isupper() and word[1:].islower():
                    capital.add(word.lower())
    return frozenset(small), frozenset(capital - small)
