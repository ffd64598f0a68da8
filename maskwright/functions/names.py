"""Name, street and city pools of our own: invented or common words, each list small."""

from __future__ import annotations

FIRST = tuple(
    """Aarav Aditi Ajay Amit Ananya Anil Anita Arjun Asha Bela Chetan Deepa Dev Divya Esha Farhan Gita Hari Isha Jaya Kabir Karan Kavya
    Kiran Lata Leela Manav Meera Mohan Naina Neha Nikhil Omkar Pooja Priya Rahul Raj Ravi Rekha Ritu Rohan Sagar Sana Sara Seema Shreya
    Sunil Tara Tushar Uma Varun Vijay Vikram Yash Zoya Alice Brian Carol David Emma Frank Grace Henry Irene James Karen Laura Martin
    Nancy Oliver Peter Rachel Simon Thomas Victor William John Mary Robert Michael Sarah Linda Susan""".split()
)
LAST = tuple(
    """Acharya Ahuja Bajaj Banerjee Bhatt Bose Chopra Das Desai Deshmukh Dutta Gandhi Ghosh Gupta Hegde Iyer Jain Joshi Kapoor Khanna
    Kulkarni Kumar Malhotra Mehta Menon Mishra Nair Naidu Pandey Patel Pillai Rana Rao Reddy Saxena Sharma Shetty Singh Sinha Thakur
    Tiwari Trivedi Varma Verma Wagle Yadav Adams Baker Clark Cooper Davies Evans Foster Green Harris Hughes Jones Lewis Miller Morris
    Parker Price Roberts Smith Taylor Turner Walker Ward White Wilson Wright Young Brown Johnson Moore""".split()
)
#: Words for brands and places, and for names when the pools above are used up: two parts each.
ONSETS = tuple("Bel Cor Dar Fen Gal Hol Jor Kel Lan Mar Nor Oak Pel Quin Ros Sel Tor Ul Ver Wex Yar Zel Bran Crest Dun Elm Fal Glen Hart Ives".split())
ENDINGS = tuple("dale ford ham mere mont nor ridge shaw stead ton vale wick worth by croft den field gate hurst ley".split())
STREETS = ("Lake Road", "Mill Lane", "Garden Street", "Station Road", "Temple Street", "Market Lane", "Hill Road", "River Street", "Park Lane", "School Road")
TOWNS = ("Alipur", "Baramati", "Chandwad", "Dapoli", "Erandol", "Fatehpur", "Gondia", "Hansi", "Islampur", "Junagadh", "Karad", "Lonavala")
GAZETTEER = frozenset(x.lower() for x in FIRST + LAST)
