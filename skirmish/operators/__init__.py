"""skirmish.operators"""
