from packetflow.llm import residue as R

DOCS = "doc_id bigint, text string, source string, kind string, hash string"
GOOD = [
    "Fees: 8% <see schedule> and $1[sic] per page.", "Our mail merge uses the marker <<name>> in the letter template, please do not delete the marker when you edit it.", 'The buyer wrote "undefined" in the middle name box.', "Mr. Null and Ms. Lorem both called about their titles today.",
    "Error codes 500 to 505 on the scale printer mean that the paper roll is empty.", "To open the fee calculator the clerk has to enable JavaScript in the browser settings first.", "Not found in the drawer: the spare seal.", "Signature: ______ Date: ____", "El formulario dice [marque uno] y el cliente.",
    "Write the plate number between the brackets [ ] and leave {optional} boxes empty.", "The trainer explained that the old portal showed an access denied page whenever the cookie was stale.", "VIN 716B86XXX7L276281 received.", "", "  \n", None, "La sesión salvo error en el M008122.",
]
BAD = [
    "Dear {{ Owner Name }},", "paid on $[Amount].", "sent to [[PLATE_NO]]", "at %dealer_city% today", "fee of ${Vin} stands", "number #{PlateNo}", "{%= OWNER_NAME %} reports", "record @@AMOUNT@@ Leasing", "notes, __Lienholder__", "fee of $XXClerkXX stands", "<<SaleDate>>", "to <SALE_DATE> in", "[INSERT dealer_city HERE]", "[ENTER VIN]",
    "Real text.\nOwner: undefined\nMore.", "Dear NaN,", "Amount due: $null", "Sale date: #REF!", "VIN: {0}", "Dear %s,", "Owner: [object Object]", "Owner: (string)", "Error! Reference source not found.", "DEAR NULL,",
    "Please enable JavaScript to view this page.", "Real content here.\nAccess denied. You do not have rights to open this record.", "404 - Not Found\nThe page you asked for could not be loaded.", "HTTP STATUS 502 – BAD GATEWAY", "Su sesión ha caducado. Vuelva a iniciar sesión.", "Página no encontrada.", "Traceback (most recent call last):\n  File", "<html><body>\nnoscript: title portal",
    "Lorem ipsum dolor sit amet", "Adipis occaec mollit veniam anim ipsum anim dolor", "Your heading goes here. Your text goes here.", "Texto de relleno. Sustituya este párrafo.", "paid to «Lienholder» on", "until &lt;dealer_city&gt; and", "blah blah blah blah title", "plea5e enab1e javascript to view this form", "x" * 300_000 + "\nOops! Something went wrong on our side.",
]


def documents(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, source, "c", "c") for i, t in enumerate(texts)], DOCS)


def test_content_stays(spark):
    assert R.found_residue(documents(spark, GOOD)).collect() == []
    assert R.clean(documents(spark, GOOD)).count() == len(GOOD)


def test_residue_is_found(spark):
    found = {r.doc_id for r in R.found_residue(documents(spark, BAD + BAD[:3])).collect()}
    assert [t[:60] for i, t in enumerate(BAD) if i not in found] == [] and len(found) == len(BAD) + 3


def test_messages_count_when_they_recur(spark):
    texts = ["Loading record 55 ...", "loading RECORD 9 ..."]
    assert R.found_residue(documents(spark, texts)).count() == 0
    many = documents(spark, texts).unionByName(documents(spark, texts[:1], "b").selectExpr("doc_id + 10 as doc_id", "text", "source", "kind", "hash"))
    assert R.found_residue(many).count() == 3


def test_unlisted_error_page_is_found_by_recurrence(spark):
    page = "Notes of the day.\nSorry, the document service is temporarily overloaded (fault 0x80{0}57), please retry in {0} minutes. Contact your administrator."
    letter = "The clerk explained that error {0} of the scale printer expired with the old browser on Elm Road."
    many = documents(spark, [page.format(10 + i) for i in range(50)], "a").unionByName(documents(spark, [letter.format(10 + i) for i in range(50)], "b").selectExpr("doc_id + 100 as doc_id", "text", "source", "kind", "hash"))
    assert R.found_residue(many).count() == 0  # one source only
    more = many.unionByName(documents(spark, [page.format(77)], "c").selectExpr("doc_id + 300 as doc_id", "text", "source", "kind", "hash"))
    assert {r.doc_id for r in R.found_residue(more).collect()} == {*range(50), 300}


def test_long_placeholders(spark):
    assert R.has_placeholder("{{ " + "owner " * 200 + "}}") and R.has_placeholder("of «Owner Name» and") and R.has_placeholder("of &lt;SALE_DATE&gt; in") and R.has_placeholder("to <" + "owner name " * 30 + "owner>")
    assert not R.has_placeholder("He wrote «gracias» and <see schedule> twice")


def test_masking():
    assert R.masked("Ref 12/03/2025 at 12 Oak Street, code a5f3.") == R.masked("ref 01/01/2020 at 9 Elm Road, CODE 77b")
