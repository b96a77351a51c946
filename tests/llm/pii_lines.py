"""Lines written by hand, apart from the generator that the tagger learns from.

Personal data is marked as ``<<kind|text>>``; lines without a mark have none.
"""

MARKED = (
    "Please write to <<email|jane dot doe at gmail dot com>> before Friday.",
    "My colleague can be reached under <<email|bob AT example DOT org>> most days.",
    "Contact: <<email|m.keller [at] stadtwerke [dot] de>>, second floor",
    "For refunds mail <<email|support (at) northwind.co>> and quote the order.",
    "Schreiben Sie an <<email|anna.schulz(at)posteo.de>>, wenn Sie Fragen haben.",
    "You may reach the editor (<<email|editor [at] weeklypost [dot] com>>) by noon.",
    "Pour toute question : <<email|claire.dupont [at] mairie.fr>> ou au guichet.",
    "Escriba a <<email|ventas [at] tiendaluz [dot] es>> para reservar.",
    "Send the form to <<email|firstname.lastname [at] department.university [dot] example [dot] org>> today.",
    "Her address is <<email|lucy_99 [at] mailbox.net>> since last year",
    "questions to <<email|help at kiwisoft dot io>> or the forum",
    "Ask <<email|thomas @ weber.de>> about the keys.",
    "Ring me on <<phone|(212) 555-0147>> after six, not earlier.",
    "Office: <<phone|415-555-0132>>, ask for Dana.",
    "Her mobile is <<phone|646.555.0199>> and she answers quickly.",
    "Tel. <<phone|0301 234 5678>>, Mo bis Fr von neun bis zwölf",
    "Rufen Sie uns an: <<phone|0711/5550192>> oder kommen Sie vorbei.",
    "the nurse left a number, <<phone|(503)555-0110>>, on the desk",
    "Dial <<phone|00 44 207 946 0958>> from abroad.",
    "Phone: <<phone|1-800-555-0175>> (free of charge)",
    "Please text <<phone|718-555-0163>> when you arrive at the gate.",
    "You can call <<phone|(617) 555-0101>> or <<phone|(617) 555-0102>> during the day.",
    "appelez le <<phone|0145 555 0188>> avant midi",
    "fax <<phone|312.555.0144>>, attention Mr Cole",
    "He paid with <<card|4111.1111.1111.1111>> last week.",
    "card no. <<card|5500/0000/0000/0004>> expires soon",
    "Amex <<card|3782-822463-10005>> was declined twice.",
    "The number <<card|3782 822463 10005>> is on file.",
    "use <<card|4012_8888_8888_1881>> for the test order",
    "Visa: <<card|4222  2222  2222  2220>> on the back",
    "The server sits at <<ip|192[.]168[.]10[.]44>> behind the wall.",
    "block <<ip|10 . 20 . 30 . 40>> at the router, please",
    "traffic came from <<ip|203[.]0[.]113[.]9>> all night",
    "we saw <<ip|198[.]51[.]100[.]23>> in the logs again",
)

CLEAN = (
    "The season 2019-2020 was the best in years.",
    "Filed on 2024-01-15 and closed on 15.01.2024, as agreed.",
    "ISBN 978-3-16-148410-0, second edition, 412 pages.",
    "Part 100-200-3000 is out of stock until May.",
    "Meet me at the dot on the map, not at the station.",
    "Version 10.2.4 fixes 312 bugs; 10.2.5 is due in 2025.",
    "It cost $1,299.00 in 1998 and 2,499.95 euros in 2004.",
    "The match ended 3-2 after 90 minutes (2-1 at half time).",
    "Chapter 12.4.1 covers pages 210-245 of the handbook.",
    "Between 1914-1918 and 1939-1945 nothing was built here.",
    "Order #55812 was shipped at 14:35 from hall 7.",
    "Look at dot com companies from the nineties.",
    "Temperatures fell to -12.5 at night and rose to 3.8 by noon.",
    "In 2021/22 the club had 4,512 members at 18 sites.",
    "He scored 1,000,000 points at level 42.",
    "Follow @northwind for news, or look at [1] and (2).",
    "On 01/02/2003 the firm had 1200 staff, 300 of them at sea.",
    "RFC 2616 section 14.9 and ISO 8601-1:2019 apply.",
    "Take exit 12B, then 400 metres; the house is number 1046.",
    "Seeds were sown on 03-04-2011 and 05-06-2012 in rows of 250.",
    "The index went from 12345.67 to 12399.10 in 24 hours.",
    "ISSN 0317-8471 and DOI 10.1000/182 are given at the end.",
)
