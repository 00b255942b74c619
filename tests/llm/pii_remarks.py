"""Remarks written by hand, apart from the training grammar and from the test tables, with the kinds they hold."""

REMARKS = [
    ("Rang the residence, Farzana Siddiqui took the message for her son", "name"),
    ("Son-in-law Gurpreet is handling all matters nowadays", "name"),
    ("Borrower insisted we deal only with Chidambaram from accounts", "name"),
    ("Had a long chat with Mrs. Olivia D'Costa regarding the overdue amount", "name"),
    ("cheque was handed to bhavesh solanki last evening", "name"),
    ("K. Raghunathan opened the gate and took the letter", "name"),
    ("Advocate Sushil Wankhede sent a reply notice", "name"),
    ("Ms Tenzin will arrange funds after harvest", "name"),
    ("lady introduced herself as Parveen Bano", "name"),
    ("Old lady there said Murugan left for Dubai in March", "name"),
    ("payment link opened by Harpreet Sodhi twice", "name"),
    ("rakesh ji ne 5 din ka time manga", "name"),
    ("Met Dr Banerjee, he runs a small dispensary", "name"),
    ("Kindly speak to Ayesha before visiting", "name"),
    ("spoke to mr venkataraman, promised part payment", "name"),
    ("UNCLE NAMED BALWINDER SINGH GILL TOOK THE CALL", "name"),
    ("Customer wants future calls to go to Nikhil Bansal instead", "name"),
    ("shopkeeper says Lobsang closed his stall", "name"),
    ("Sushmita Mukhopadhyay disputes the foreclosure charges", "name"),
    ("Person attending said Selvi went to market", "name"),
    ("Please update cell to 9123456780 in system", "phone"),
    ("the boy gave 70123 45678 for further talks", "phone"),
    ("can be rung at +91 81234 56789 post lunch", "phone"),
    ("got another sim, 080-26543210 is the clinic desk", "phone"),
    ("his sister can be had on 9988776655 any time", "phone"),
    ("ring him at six three zero one double two four five nine eight", "phone"),
    ("asked me to msg 7338-221-904 only", "phone"),
    ("primary 8899001122 dead, secondary 7766554433 rings", "phone"),
    ("number is +919012345678 and it works on telegram too", "phone"),
    ("ph 0484 2345678 belongs to the workshop", "phone"),
    ("Mail soft copy at ritu.dev92@outlook.com please", "email"),
    ("wants foreclosure letter on s_kulshrestha@yahoo.co.in", "email"),
    ("id given is mohit dot rana at rediffmail dot com", "email"),
    ("statement undelivered: tech-support@brightpath.org bounced", "email"),
    ("cc his accountant: accounts.desk@finserve-partners.in", "email"),
    ("new gmail shared kavya123[at]gmail.com", "email"),
    ("PAN seen, reads BQKPS4821L", "id_number"),
    ("her aadhaar ends up as 4821 7730 1946 in the form", "id_number"),
    ("voter card ABX1234567 produced at gate", "id_number"),
    ("carrying passport Z4587712, valid till 2031", "id_number"),
    ("uid 903412875566 does not match the photo", "id_number"),
    ("driving licence MH14 20110062821 was in the folder", "id_number"),
    ("tax card number given aapfu0939f", "id_number"),
    ("Scanned Aadhaar: 7002-1183-5540", "id_number"),
    ("located at Door No 14-2-88, Tilak Road, Nizamabad", "address"),
    ("she now occupies Flat 7B, Emerald Heights, Baner Road, Pune 411045", "address"),
    ("office moved, new one is Plot 221, Sector 18, Gurugram", "address"),
    ("reached 45/3 Subhash Marg, lock on door", "address"),
    ("H.No. 9, Gali No 3, Shastri Nagar is where the mother is", "address"),
    ("courier returned from #302, 4th Cross, Vijaya Colony", "address"),
    ("house no 17 patrakar colony mein shift ho gayi", "address"),
    ("Shop No 5, Mahavir Market, Station Road sealed by owner", "address"),
    ("traced to 1102 Hibiscus Towers, Hill Lane, Kandivali", "address"),
    ("Quarter 12/C, Railway Colony, Kharagpur visited at noon", "address"),
    ("Met Jaspal Randhawa at 88 Model Lane, he gave 9090909012", "name address phone"),
    ("Noor Jahan (9345012345) will mail noorj@zoho.com scans", "name phone email"),
    ("pan BNZPM2501J and mobile 8008008001 both updated", "id_number phone"),
    ("Wrote to meera.k@proton.me, copy of uid 612345678901 awaited", "email id_number"),
    ("Premises shut, board says To Let", ""),
    ("Wants interest waived before discussing anything", ""),
    ("Queried late fee of 1,450 on the April cycle", ""),
    ("IMPS ref 402918837465 shows success but ledger is blank", ""),
    ("loan account 5500123489 clubbed with 5500123490", ""),
    ("Regional Head approved two instalments", ""),
    ("Harvest delayed by rain, income expected in November", ""),
    ("Sunrise Motors confirmed he resigned", ""),
    ("moved to Coimbatore for treatment", ""),
    ("native of Bhagalpur, returns after Chhath", ""),
    ("kal subah tak paisa daal denge bola", ""),
    ("ghar pe taala laga tha, padosi ko bhi nahi pata", ""),
    ("Maruti Alto repossessed and parked at yard", ""),
    ("Ticket 88012345 escalated to Nodal Desk", ""),
    ("Elderly parents at home, extremely polite", ""),
    ("Promised 12000 on 15/08 and balance next Friday", ""),
    ("Hospital bills pending, asks for three months moratorium", ""),
    ("Dhaba owner threatened our executive", ""),
    ("Insists NACH bounce charges be reversed", ""),
    ("e-challan 1190034562871 cleared at RTO", ""),
    ("Store Supervisor said nobody by that name works there", ""),
    ("Gold ornaments pledged elsewhere, auction on 21st", ""),
    ("mailbox full, no voice mail either", ""),
    ("cust bahut gusse mein tha, phone kaat diya", ""),
    ("Branch relocated opposite Town Hall", ""),
    ("Got down at Majestic, could not find the lane", ""),
    ("PTP broken thrice; legal notice despatched", ""),
    ("Samsung handset finance closed in 2023", ""),
    ("passport size photo asked, not given", ""),
    ("Language barrier, route to Malayalam queue", ""),
]

#: A second set, written when the detector seemed done; README has the figures of its first run, too.
FRESH = [
    ("Daughter-in-law Rukmini says father in law handles money", "name"),
    ("Gatekeeper confirmed Mr Thangaraj sold the flat in January", "name"),
    ("handed demand letter to prabhakar naik at the counter", "name"),
    ("Loan was taken on behalf of Zubair Merchant, a cousin", "name"),
    ("Sister Kuldeep Kaur wept and asked for a week", "name"),
    ("we were received by Shri Omkarnath Trivedi himself", "name"),
    ("Bhagwan Das ji se mulakat hui, wo taiyar hain", "name"),
    ("CALL TAKEN BY MRS GERALDINE PINTO", "name"),
    ("vehicle is with a friend called Tenzing Bhutia", "name"),
    ("S. Muthuvel quarrelled with our agent", "name"),
    ("It was Pradyumna who signed, not the wife", "name"),
    ("Wants to hear only from Ms. Saraswathi of collections", "name"),
    ("spare handset 9812309876 kept with the driver", "phone"),
    ("please note 63000 12121 as day time line", "phone"),
    ("says whatsapp her on +91-7004004004", "phone"),
    ("shop landline (0431) 2412345 picked by helper", "phone"),
    ("old 9440012345 surrendered, uses 8330098765", "phone"),
    ("nine eight four zero five five one two three seven is his roaming line", "phone"),
    ("Soft copies went to devika_menon@live.in", "email"),
    ("mail bounced from kishore.b77@gmail.com twice", "email"),
    ("asks us to write to grievance.cell@northwind.co.in", "email"),
    ("typed pallavi dot s at hotmail dot com on chat", "email"),
    ("Form 60 given since PAN CFRPM9087D is inoperative", "id_number"),
    ("aadhar card 3345 9087 1123 laminated, photo faded", "id_number"),
    ("Voter slip shows WKH7765012", "id_number"),
    ("passport K9981234 surrendered to agent", "id_number"),
    ("DL no KA05 20190004567 validated on portal", "id_number"),
    ("says uid is 778812340099 but OTP goes elsewhere", "id_number"),
    ("Family rents 2nd floor, No 54, Thiru Vi Ka Street, Mylapore", "address"),
    ("godown is at Plot No 9A, Phase 2, Jeedimetla", "address"),
    ("parents stay in House No 231, Ward 6, Sirsa", "address"),
    ("shifted his clinic to 19/2 Cunningham Road, Bengaluru", "address"),
    ("Flat A-604, Silver Oak Residency, Wakad Road is on rent", "address"),
    ("bailiff went to door no 3-4-56, Barkatpura Lane", "address"),
    ("she may be found at B-17, Sector 62, Noida", "address"),
    ("Left card with Yashpal at 7 Church Street, call 9900887766", "name address phone"),
    ("Anwar Basha mailed anwar.b@gmail.com proof of payment", "name email"),
    ("Wedding in the family, funds after 20th", ""),
    ("Has two other loans, juggling payments", ""),
    ("RTGS 309988776655 returned, beneficiary name mismatch", ""),
    ("Agreement 20210098765 foreclosed last quarter", ""),
    ("Reached Vijayawada depot, vehicle not there", ""),
    ("Recovered 4,500 in cash, receipt 887766 issued", ""),
    ("Company laid him off, joining new job in June", ""),
    ("Asked for supervisor call back between 4 and 6 pm", ""),
    ("Annapurna Stores said rent unpaid too", ""),
    ("wife unaware of the loan, be discreet", ""),
    ("bola ki byaj bahut zyada hai, kam karo", ""),
    ("Number busy, tried thrice since noon", ""),
    ("Kotak statement shows salary stopped in Feb", ""),
    ("Field visit cancelled owing to heavy rain in Mangaluru", ""),
    ("settled with other lender, wants same waiver", ""),
    ("Shop shutter down, signboard removed", ""),
    ("Postal acknowledgement RL 445566778 filed", ""),
]
