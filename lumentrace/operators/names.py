"""A short name list of our own; larger lists come as tables (see ``person_names``)."""

FORENAMES = ("Anna Ben Carla David Emma Felix Grace Henry Iris James Julia Karl Laura Marc Maria Nina Oscar Paul Rosa Sarah Thomas "
             "Uwe Vera William Yves Zoe John Jane Mary Robert Linda Michael Peter Claire Pierre Marie Jean Carlos Ana Luis").split()
SURNAMES = ("Adams Bauer Clark Dubois Evans Fischer Garcia Hill Ivanov Jones Keller Lopez Martin Nguyen Olsen Petit Quinn Roberts Smith "
            "Taylor Ullmann Vogel Walker Young Zimmer Doe Brown Miller Wilson Moreau Laurent Hernandez Perez Schmidt Weber").split()
